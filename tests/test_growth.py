"""Queries that pair or gather rows, on tables whose copies would make pairs without end."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import catalog


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """One country: 20,000 observations of five times by ten customers, 200,000 lines shipped on two days."""
    d = str(tmp_path_factory.mktemp("dense"))
    c = duckdb.connect()
    put = lambda name, sql: c.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    for t in ("nation", "region", "part"):
        put(t, f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    put("supplier", "SELECT * REPLACE (3 AS s_nationkey) FROM '/root/testdata/sf0.001/supplier.parquet' LIMIT 1")
    put("customer", "SELECT * REPLACE (3 AS c_nationkey) FROM '/root/testdata/sf0.001/customer.parquet' ORDER BY c_custkey LIMIT 10")
    line = "SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 1"
    put("lineitem", f"""SELECT l.* REPLACE (i AS l_orderkey, (SELECT min(s_suppkey) FROM '{d}/supplier.parquet') AS l_suppkey, CAST(1 + i % 2 AS INTEGER) AS l_linenumber, CAST(0 AS DOUBLE) AS l_discount,
        TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(i % 2 AS INTEGER) AS l_shipdate) FROM ({line}) l, range(200000) t(i)""")
    event = "SELECT * FROM '/root/testdata/sf0.001/events.parquet' LIMIT 1"
    put("events", f"""SELECT e.* REPLACE (i AS event_id, (SELECT min(c_custkey) FROM '{d}/customer.parquet') + i % 10 AS user_id, 'error' AS event_type, TIMESTAMP '2024-01-01' + INTERVAL 30 SECOND * CAST(i % 5 AS INTEGER) AS ts)
        FROM ({event}) e, range(20000) t(i)""")
    return d


def test_dividend_block_takes_no_amount_for_absent(spark, small, tmp_path):
    """A customer without orders, and one whose only order has no price, have no dividend; a null price isn't the latest."""
    d, c = str(tmp_path), duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{small}/customer.parquet' ORDER BY c_custkey LIMIT 3) TO '{d}/customer.parquet' (FORMAT parquet)")
    c.execute(f"""COPY (WITH k AS (SELECT min(c_custkey) AS k FROM '{d}/customer.parquet') SELECT o.* REPLACE (i AS o_orderkey, CASE WHEN i = 0 THEN k ELSE k + 1 END AS o_custkey, CASE WHEN i = 1 THEN 5000.0 END AS o_totalprice)
        FROM (SELECT * FROM '{small}/orders.parquet' LIMIT 1) o, k, range(3) t(i)) TO '{d}/orders.parquet' (FORMAT parquet)""")
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = catalog.QUERIES["mkt_dividend_block"](spark, d).select("c_custkey", "present", "amount", "yield_proxy")
    want = c.execute(f"SELECT c_custkey, present, amount, yield_proxy FROM ({catalog.ORACLES['mkt_dividend_block']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in got.orderBy("c_custkey").collect()] == [tuple(map(float, r)) for r in want]
    assert [r[1] for r in want] == [0.0, 1.0, 0.0]


def test_lead_lag_rules_count_copies_before_they_pair_them(spark, dense):
    """Observations lie at 0, 2,490, .. 9,960 s of the first day, so only the second day's lines follow all of them."""
    (r,) = catalog.QUERIES["drf_lead_lag_rules"](spark, dense).collect()
    # the third quartile of five lags is the fourth; a fifth of the pairs lies beyond it
    assert (r.src, r.dst, r.hits, r.win_s) == ("error", 3, 16_000 * 100_000, 86_400 - 2_490)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.75, 1.0])
def test_weighted_quantile_is_that_of_the_repeated_rows(spark, q):
    import numpy as np

    from tessella.operators.stats import weighted_quantile

    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(w)) for k in ("a", "b") for v, w in zip(rng.integers(0, 40_000, 300) / 8, rng.integers(1, 50, 300), strict=True)]
    rows += [("one", 7.5, 1), ("far", 0.0, 3), ("far", 1e6, 1)]
    got = {r.k: r for r in weighted_quantile(spark.createDataFrame(rows, "k string, x double, c long"), ["k"], "x", "c", q).collect()}
    for k in ("a", "b", "one", "far"):
        each = np.repeat([x for key, x, _ in rows if key == k], [c for key, _, c in rows if key == k])
        assert got[k].n == len(each)
        assert got[k].quantile == pytest.approx(np.quantile(each, q))
        assert got[k].mean == pytest.approx(each.mean())


def test_store_l3_counts_events_before_it_pairs_them(spark, dense):
    """20,000 observations near 200,000 events of the lowest score: four thousand million pairs, of a score of 0.5 or more all."""
    got = catalog.QUERIES["join_store_l3"](spark, dense)
    assert got.count() == 20_000
    assert {r.patterns for r in got.select("patterns").distinct().collect()} == {200_000}
    assert got.where("obs_id = 0").select("best").first()[0] == 1.0


def test_co_occurrence_table_counts_copies_before_it_pairs_them(spark, dense):
    got = [tuple(r) for r in catalog.QUERIES["drf_co_occurrence_table"](spark, dense).select("src", "dst", "n").collect()]
    assert got == [(2, 3, 100_000 * 100_000)]


@pytest.mark.parametrize("name", ["top_best_window_cluster", "top_best_sell_cluster"])
def test_clusters_do_not_join_filings_to_anchors(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_nearest_keeps_the_best_of_a_task_in_small_tiles(spark, monkeypatch):
    import numpy as np

    from tessella import session
    from tessella.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 32)
    monkeypatch.setattr(vectors, "TILE", 256)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (600, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(tuple(r) for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(next(p for p in reversed(session._written[spark.sparkContext.applicationId]) if "/nearest-" in p)).count() == 30 * 5
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(n < 1e-12, 0.0, x / np.maximum(n, 1e-12))
    want = []
    for q in range(0, 600, 20):
        s = np.round(u @ u[q], 6) + 0.0
        want += [(q, i, s[i]) for i in sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in sorted(want)]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in sorted(want)])


def test_names_are_compared_once_however_many_parts_share_them(spark, small, tmp_path):
    """20,000 parts of one name and block, and one of another: two names, 200 million pairs."""
    duckdb.execute(f"COPY (SELECT p.* REPLACE (i AS p_partkey, CASE WHEN i = 7 THEN 'aaaa zzzzqqqq' ELSE 'aaaa bcd' END AS p_name) FROM (SELECT * FROM '{small}/part.parquet' LIMIT 1) p, range(20001) t(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    out = catalog.QUERIES["grf_similarity_levels"](spark, str(tmp_path)).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in out} == {0: 20_000, 2: 20_000 * 19_999 // 2}


def test_pairs_of_one_name_are_dealt(spark, small, tmp_path, monkeypatch):
    """4,000 parts of one name and 40 of two others, some without key, name or size and some with the same key: one task made all pairs of a name."""
    from tessella.operators import joins

    d, c = str(tmp_path), duckdb.connect()
    c.execute(f"""COPY (SELECT p.* REPLACE (CASE WHEN i % 500 = 3 THEN NULL ELSE i // 2 * 2 + i % 3 END AS p_partkey, CASE WHEN i % 101 = 7 THEN 'aaaa zzzzqqqq' WHEN i % 505 = 8 THEN 'aaaa bcde' WHEN i % 333 <> 9 THEN 'aaaa bcd' END AS p_name,
        CASE WHEN i % 444 <> 5 THEN 1 END AS p_size) FROM (SELECT * FROM '{small}/part.parquet' LIMIT 1) p, range(4040) t(i)) TO '{d}/part.parquet' (FORMAT parquet)""")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    monkeypatch.setattr(joins, "PAIRS", 100_000)
    df = catalog.QUERIES["grf_similarity_levels"](spark, d)
    by_task = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(by_task) < sum(by_task) / 10
    got = sorted(tuple(r) for r in df.groupBy("level", (F.col("a") % 64).alias("m")).agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b"))).collect())
    assert got == sorted(tuple(map(int, r)) for r in c.execute(f"SELECT level, a % 64, count(*), sum(a), sum(b), sum(a * b) FROM ({catalog.ORACLES['grf_similarity_levels']}) GROUP BY 1, 2").fetchall())


def test_links_of_one_code_are_dealt(spark, small, tmp_path, monkeypatch):
    """1,000 topics and 100 instruments of one code: one task made all their links, each with its own pair of strings from the join."""
    from tessella.operators import joins

    d, c = str(tmp_path), duckdb.connect()
    c.execute(f"COPY (SELECT o.* REPLACE (i AS o_orderkey, CASE WHEN i % 100 = 1 THEN 7 ELSE 50 * (i % 30) END AS o_custkey, 'F' AS o_orderstatus) FROM (SELECT * FROM '{small}/orders.parquet' LIMIT 1) o, range(1010) t(i)) TO '{d}/orders.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT o.* REPLACE (CASE WHEN i % 50 = 3 THEN 50 * i + 7 ELSE 50 * i END AS c_custkey, CASE WHEN i <> 9 THEN 'BUILDING' END AS c_mktsegment) FROM (SELECT * FROM '{small}/customer.parquet' LIMIT 1) o, range(103) t(i)) TO '{d}/customer.parquet' (FORMAT parquet)")
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    monkeypatch.setattr(joins, "PAIRS", 2_000)
    df = catalog.QUERIES["nrm_polymarket_links"](spark, d)
    by_task = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(c.execute(f"SELECT entity_a, entity_b, link_type FROM ({catalog.ORACLES['nrm_polymarket_links']})").fetchall())
    assert len(got) > 99_000 and max(by_task) < len(got) / 4


def test_resolution_counts_levels_by_names(spark, small, tmp_path):
    """The level of 200 million equal pairs is too common to be evidence; what is left are the pairs with the odd part."""
    duckdb.execute(f"COPY (SELECT p.* REPLACE (i AS p_partkey, CASE WHEN i = 7 THEN 'aaaa zzzzqqqq' ELSE 'aaaa bcd' END AS p_name) FROM (SELECT * FROM '{small}/part.parquet' LIMIT 1) p, range(20001) t(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["grf_probabilistic_resolution"](spark, str(tmp_path))
    odds = 0.05 / (20_000 / (20_001 * 20_000 // 2)) * 0.05 / 0.95
    assert got.count() == 20_000
    assert [r.p for r in got.select("p").distinct().collect()] == [round(odds / (1 + odds), 6)]
    assert got.where("a <> 7 and b <> 7").count() == 0


def test_persistence_stream_deals_a_source_over_keys(spark, small, monkeypatch):
    """No key of the stream may hold the rows of all fingerprints of a source."""
    from tessella.plans import streams

    seen = []
    ran = streams.stateful.run
    monkeypatch.setattr(streams.stateful, "run", lambda s: seen.append(ran(s)) or seen[-1])
    out = catalog.QUERIES["str_persistence_stream"](spark, small)
    assert out.count() > 0
    held = streams.stateful.stored(spark, seen[0].marks)
    sources = out.select("source").distinct().count()
    assert held.select("key.key").distinct().count() > 5 * sources


def test_persistence_parts_forgets_what_the_cycle_before_did_not_name():
    from tessella.streaming import stateful

    fold = stateful.persistence_parts(2)
    state, out = fold.step(None, 10, [("a", -1), ("b", -1), ("a", -1)])
    state, out = fold.step(state, 20, [("a", 10), ("c", 10)])
    assert out == [(20, "a", 2)]
    state, out = fold.step(state, 40, [("a", 30), ("b", 30)])  # the part saw nothing at 30, its source did
    assert out == [] and state == {"a": (1, 40), "b": (1, 40)}


def test_rows_that_wait_for_the_watermark_are_one_value_of_a_key(spark, small, monkeypatch):
    """A key's waiting rows were a state row each, written and read one by one."""
    from tessella.plans import streams

    seen = []
    ran = streams.stateful.run
    monkeypatch.setattr(streams.stateful, "run", lambda s: seen.append(ran(s)) or seen[-1])
    catalog.QUERIES["str_heartbeat_stream"](spark, small)
    held = streams.stateful.stored(spark, seen[0].marks, "waiting").groupBy("key").count().collect()
    assert held and {r["count"] for r in held} == {1}


@pytest.mark.parametrize("name", ["src_complete_pending", "join_self_pair", "nrm_creditor_filings_links"])
def test_tasks_stay_small_where_the_table_grows(spark, small, name, monkeypatch):
    """Partitions were the session's, put together to few: their number has to follow the rows."""
    from tessella import session

    monkeypatch.setattr(session, "PART_ROWS", 100)
    df = catalog.QUERIES[name](spark, small)
    n = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 100)
    assert "RepartitionByExpression" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and f"], {n}" in plan


@pytest.mark.parametrize("name", ["join_insider_x_event", "join_transfer_x_event", "join_vessel_x_sanctions", "join_linked_co_occurrence"])
def test_alike_rows_meet_as_packs(spark, dense, tmp_path, monkeypatch, name):
    """200 observations of five times and 20,000 events of two: they were joined row by row, now some forty packs meet."""
    from tessella.operators import joins
    from tessella.plans import joining

    d, c = str(tmp_path), duckdb.connect()
    kind = "purchase" if name == "join_linked_co_occurrence" else "error"
    made = {"events": f"SELECT * REPLACE ('{kind}' AS event_type, 40.0 AS value) FROM '{dense}/events.parquet' WHERE event_id < 200", "lineitem": f"SELECT * REPLACE (3 AS l_linenumber) FROM '{dense}/lineitem.parquet' WHERE l_orderkey < 20000"}
    for t in ("nation", "region", "part", "supplier", "customer", "lineitem", "events"):
        made.setdefault(t, f"SELECT * FROM '{dense}/{t}.parquet'")
        c.execute(f"COPY ({made[t]}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sides = []
    plain = joining.interval_join
    monkeypatch.setattr(joining, "interval_join", lambda a, b, *args, **kw: sides.extend([a, b]) or plain(a, b, *args, **kw))
    df = catalog.QUERIES[name](spark, d)
    assert sides[0].count() <= 2 * 20_000 / joins.PACK and sides[1].count() == 5
    assert max(len(r.rows) for r in sides[0].select("rows").collect()) < 1.5 * joins.PACK
    # all pairs, by sums over them
    sums = ", ".join(f"sum({x})" for x in df.columns if x != "country")
    df.createOrReplaceTempView("packed_pairs")
    got = spark.sql(f"SELECT count(*), {sums} FROM packed_pairs").first()
    want = c.execute(f"SELECT count(*), {sums} FROM ({catalog.ORACLES[name]})").fetchone()
    assert want[0] == 4_000_000
    assert list(map(float, got)) == pytest.approx(list(map(float, want)), rel=1e-9)


def orders_sql(rows) -> str:
    """Orders (key, customer, date, priority) as a VALUES list."""
    put = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CAST(o_orderpriority AS VARCHAR) AS o_orderpriority FROM (VALUES " + ", ".join(f"({', '.join(map(put, r))})" for r in rows) + ") t(o_orderkey, o_custkey, o_orderdate, o_orderpriority)"


def resolved(spark, d, rows: str):
    c = duckdb.connect()
    c.execute(f"COPY ({rows}) TO '{d}/orders.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["grf_resolved_components"](spark, d).select("node", "root").collect())
    return got, sorted(c.execute(f"SELECT node, root FROM ({catalog.ORACLES['grf_resolved_components']})").fetchall())


ODD_ORDERS = {
    "missing keys are one": [(1, 1, "1995-01-01", None), (2, 2, None, "a"), (3, None, "1996-01-01", "b"), (4, 2, "1997-01-01", "a"), (5, 9, "1995-01-01", "a")],
    "an order of two customers": [(1, 1, "1995-01-01", "a"), (7, 1, "1995-01-09", "b"), (7, 2, "1996-01-01", "c"), (3, 2, "1996-01-02", "d"), (9, 3, "1995-01-01", "a"), (9, 4, "1995-01-01", "a")],
    "a priority like a month": [(5, 1, "1995-01-01", "a"), (2, 1, "1999-01-01", "199501"), (8, 2, "1999-01-01", "199501")],
    "no order": [],
}


@pytest.mark.parametrize("kind", ODD_ORDERS)
def test_components_of_odd_orders(spark, small, tmp_path, kind):
    rows = ODD_ORDERS[kind]
    got, want = resolved(spark, str(tmp_path), orders_sql(rows) if rows else orders_sql([(1, 1, None, None)]) + " WHERE false")
    assert got == want
    assert bool(want) == bool(rows)


@pytest.mark.parametrize("length", [10, 120])
def test_components_spread_within_a_customer(spark, tmp_path, monkeypatch, length):
    """A chain of months and priorities, the smallest order at its far end, and a customer of 20,000 orders in ten cells: one
    shuffle by customer and no round of joins, but for chains longer than the passes."""
    from tessella.plans import graphs

    chain = [(1000 - i, 1, f"{1900 + (i + 1) // 2}-01-01", f"p{i // 2}") for i in range(length)]
    joins = []
    plain = graphs.components
    monkeypatch.setattr(graphs, "components", lambda *a: joins.append(a) or plain(*a))
    many = "SELECT 2000 + i, 2, TIMESTAMP '1995-01-01' + INTERVAL 40 DAY * CAST(i % 2 AS INTEGER), 'p' || (i % 10) FROM range(20000) t(i)"
    duckdb.connect().execute(f"COPY ({orders_sql(chain)} UNION ALL {many}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = {r.root: r.n for r in catalog.QUERIES["grf_resolved_components"](spark, str(tmp_path)).groupBy("root").agg({"*": "count"}).toDF("root", "n").collect()}
    assert got == {1001 - length: length, 2000: 10_000, 2001: 10_000}
    assert len(joins) == (length > 10)


@pytest.mark.parametrize("name", ["join_insider_x_event", "join_transfer_x_event", "join_vessel_x_sanctions"])
def test_pairs_of_one_country_and_day_are_dealt(spark, dense, tmp_path, monkeypatch, name):
    """1,000 observations of five times and 4,000 events of two days: two tasks made all pairs, a pair of packs up to 400,000 at once."""
    from tessella import session
    from tessella.operators import joins
    from tessella.plans import joining

    d, c = str(tmp_path), duckdb.connect()
    made = {"events": f"SELECT * REPLACE (40.0 AS value) FROM '{dense}/events.parquet' WHERE event_id < 1000", "lineitem": f"SELECT * FROM '{dense}/lineitem.parquet' WHERE l_orderkey < 4000"}
    for t in ("nation", "region", "part", "supplier", "customer", "lineitem", "events"):
        made.setdefault(t, f"SELECT * FROM '{dense}/{t}.parquet'")
        c.execute(f"COPY ({made[t]}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    monkeypatch.setattr(session, "PART_ROWS", 100)
    monkeypatch.setattr(joins, "PAIRS", 100_000, raising=False)
    met = []
    plain = joining.interval_join
    monkeypatch.setattr(joining, "interval_join", lambda *args, **kw: met.append(plain(*args, **kw)) or met[0])
    df = catalog.QUERIES[name](spark, d)
    largest = met[0].selectExpr("max(size(l.rows))", "max(size(r.rows))").first()
    assert max(largest) <= 64
    by_task = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 4_000_000
    assert max(by_task) < 1_000_000
    sums = ", ".join(f"sum({x})" for x in df.columns)
    df.createOrReplaceTempView("dealt_pairs")
    got = spark.sql(f"SELECT count(*), count(DISTINCT obs_id, event_key), {sums} FROM dealt_pairs").first()
    want = c.execute(f"SELECT count(*), count(DISTINCT (obs_id, event_key)), {sums} FROM ({catalog.ORACLES[name]})").fetchone()
    assert list(map(float, got)) == pytest.approx(list(map(float, want)), rel=1e-9)
