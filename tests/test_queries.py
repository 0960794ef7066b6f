"""Every registered query of the observation side against its DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessella import catalog


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    return str(v)


def key(row):
    return [(x is None, isinstance(x, str), 0 if x is None or isinstance(x, str) else round(x, 2), x if isinstance(x, str) else "") for x in row]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in got.fetchall()), key=key)
    have = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-5)), (name, a, b)


def test_queries_without_sql_have_a_brute_force_test():
    from . import test_brute

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(test_brute.CHECKED)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


#: Values whose mean is the step itself, but not when added as doubles from left to right; and some that have no such decimals.
ON_A_STEP = {75: [90.03, 126.17, 55.22, 28.58], 25: [30.76, 39.1, 18.9, 11.24], 20: [39.3, 11.82, 23.86, 5.02]}
OFF_THE_STEPS = [[float("nan"), 1.0], [float("inf"), 1.0], [1e30, 1.0], [2 / 3, 25.0], [None, None]]


@pytest.mark.parametrize("back", [False, True])
def test_means_on_a_step_do_not_depend_on_the_order(spark, small, tmp_path, back):
    groups = [*ON_A_STEP.values(), *OFF_THE_STEPS]
    rows = [(user, repr(v)) for user, values in enumerate(groups) for v in (values[::-1] if back else values)]
    rows = ", ".join(f"({i}, {user}, {'NULL' if v == 'None' else repr(v)})" for i, (user, v) in enumerate(rows))
    event = f"SELECT * FROM '{small}/events.parquet' LIMIT 1"
    duckdb.execute(f"COPY (SELECT e.* REPLACE (i AS event_id, u AS user_id, 'flu' AS event_type, CAST(v AS DOUBLE) AS value) FROM ({event}) e, (VALUES {rows}) t(i, u, v) ORDER BY i) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["mod_disease_surveillance_wastewater"](spark, str(tmp_path)).collect()
    assert [(r.pathogen, r.total_samples, r.states, r.surge_count, r.quiet_count) for r in got] == [("flu", 22, 8, 4, 2)]
    got = {r.point: (r.ndvi, r.health) for r in catalog.QUERIES["mod_satellite_activity_vegetation"](spark, str(tmp_path)).collect()}
    assert [got[f"customer:{i}"] for i in range(3)] == [(0.75, "healthy"), (0.25, "stressed"), (0.2, "stressed")]
    assert [got[f"customer:{i}"] for i in (6, 7)] == [(0.128333, "bare"), (None, "healthy")]
