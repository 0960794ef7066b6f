"""Hand cases and properties of the helpers that most queries rest on."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import drift, folds, graphs, joins, stats, topology, vectors
from tessella.plans.ranking import diversified
from tessella.plans.series import dedupe_latest, trailing_run, z_against, before
from tessella.sources import store

from .test_brute import maximal_cliques

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
POINTS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), max_size=25)


def timed(spark, rows, name):
    return spark.createDataFrame([(k, i, float(t)) for i, (k, t) in enumerate(rows)], f"k int, {name} int, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


@QUIET
@given(POINTS, POINTS, st.integers(1, 120))
def test_interval_join_is_the_theta_join(spark, a, b, window):
    got = joins.interval_join(timed(spark, a, "i"), timed(spark, b, "j"), window, ["k"]).select("l.i", "r.j").collect()
    want = [(i, j) for i, (k, t) in enumerate(a) for j, (m, u) in enumerate(b) if k == m and abs(t - u) <= window]
    assert sorted(map(tuple, got)) == sorted(want)


@QUIET
@given(POINTS, POINTS, st.sampled_from(["backward", "forward"]), st.booleans())
def test_asof_join(spark, a, b, direction, strict):
    got = joins.asof_join(timed(spark, a, "i"), timed(spark, b, "j"), ["k"], "ts", "ts", "j", direction, strict).select("i", F.unix_timestamp("found.ts").alias("t"), "found.value").collect()
    assert len(got) == len(a)
    for r in got:
        k, t = a[r.i]
        fits = [(u, j) for j, (m, u) in enumerate(b) if m == k and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
        near = (max if direction == "backward" else min)((u for u, _ in fits), default=None)
        assert r.t == near
        assert r.value == (None if near is None else max(j for u, j in fits if u == near))


@QUIET
@given(st.lists(st.floats(1e-6, 1), min_size=1, max_size=30))
def test_benjamini_hochberg(spark, ps):
    got = stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", 0.1).collect()
    order, m = sorted(ps), len(ps)
    limit = max((p for k, p in enumerate(order, 1) if p <= 0.1 * k / m + 1e-15), default=-1)
    for r in got:
        if abs(r.p_adjusted - 0.1) > 1e-9:
            assert r.rejected == (r.p <= limit)


@QUIET
@given(st.lists(st.floats(-4, 8), min_size=1, max_size=30))
def test_cusum(spark, zs):
    got = folds.cusum(spark.createDataFrame([(1, i, z) for i, z in enumerate(zs)], "k int, i int, z double"), ["k"], ["i"], "z").orderBy("i").collect()
    s = 0.0
    for r, z in zip(got, zs, strict=True):
        s = min(max(0.0, s + z - 0.5), 50.0)
        assert math.isclose(r.s, s, abs_tol=1e-9) and r.alert == (s > 5)
        s = 0.0 if s > 5 else s


def test_hawkes(spark):
    ts = [0.0, 86_400.0, 86_400.0 * 3]
    got = folds.hawkes(spark.createDataFrame([(1, t) for t in ts], "k int, t double"), ["k"], ["t"], "t").orderBy("t").collect()
    a1 = math.exp(-1)
    a2 = math.exp(-2) * (a1 + 1)
    assert np.allclose([r.a for r in got], [0, a1, a2])


def test_causal_score_of_the_hand_case(spark):
    xs = [100.0] * 45 + [150.0, 155.0, 160.0, 165.0, 170.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)] + [(2, i, 5.0) for i in range(50)] + [(3, i, float(i)) for i in range(2)], "k int, i int, x double")
    z = df.withColumn("z", z_against(F.col("x"), before(["k"], "i"), 19))
    last = {r.k: r.z for r in z.groupBy("k").agg(F.max_by("z", "i").alias("z")).collect()}
    assert last[1] > 2 and last[2] is None and last[3] is None


def test_diversified_takes_from_every_bucket_first(spark):
    rows = [("a", i, 100.0 - i) for i in range(10)] + [("b", 20, 1.0), ("c", 21, 0.5)]
    got = diversified(spark.createDataFrame(rows, "b string, i int, s double"), ["b"], "s", "i", 5).collect()
    assert [r.i for r in got] == [0, 20, 21, 1, 2]


def test_dedupe_and_runs(spark):
    df = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (2, 10, 1, "c")], "e int, t int, id int, v string")
    assert {(r.e, r.v) for r in dedupe_latest(df, ["e", "t"], "id").collect()} == {(1, "b"), (2, "c")}
    runs = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 4, 6, 5, 4])] + [(2, 0, 1)], "k int, i int, x int")
    got = {r.k: r.n for r in trailing_run(runs, ["k"], "i", lambda w: F.col("x") < F.lag("x").over(w), "n").collect()}
    assert got == {1: 2, 2: 0}


def test_store_contracts(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e"), (3, 2, "f")], "k int, v int, x string")
    assert {(r.k, r.x) for r in store.upsert(old, new, ["k"], "v").collect()} == {(1, "c"), (2, "d"), (3, "f")}
    assert {(r.k, r.x) for r in store.insert_ignore(old, new, ["k"], ["v"]).collect()} == {(3, "e")}
    left = store.delete_range(old.union(spark.createDataFrame([(9, None, "z")], "k int, v int, x string")), 1, 5, "v")
    assert {r.k for r in left.collect()} == {2, 9}
    done, pending = store.complete_pending(old, new.select("k").distinct().where("k = 1"), "k")
    assert [r.k for r in done.collect()] == [1] and [r.k for r in pending.collect()] == [2]


def test_append_writes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "s1", 0.0), (2, "s2", 90_000.0)], "id int, source string, s double").withColumn("ts", F.timestamp_seconds("s"))
    for _ in range(2):
        store.append(df, str(tmp_path / "obs"))
    back = spark.read.parquet(str(tmp_path / "obs"))
    assert back.count() == 4 and back.where("source = 's2'").count() == 2


def test_cliques_of_any_size_and_number(spark):
    large = [f"m{i:02}" for i in range(13)]
    e = [(a, b) for i, a in enumerate(large) for b in large[i + 1 :]]
    assert [tuple(r.members) for r in graphs.cliques(spark.createDataFrame(e, "a string, b string")).collect()] == [tuple(large)]
    many = spark.range(10_001).selectExpr("concat('a', id) as a", "concat('b', id) as b")
    assert graphs.cliques(many, least=2).count() == 10_001


def test_a_large_planted_clique_and_random_graphs(spark):
    rng = random.Random(4)
    planted = [f"p{i:02}" for i in range(40)]
    e = [(a, b) for i, a in enumerate(planted) for b in planted[i + 1 :]] + [(p, f"q{rng.randrange(30)}") for p in planted for _ in range(3)]
    got = [tuple(r.members) for r in graphs.cliques(spark.createDataFrame(sorted(set(e)), "a string, b string")).collect()]
    assert tuple(planted) in got and len(got) == len(set(got))
    for n, share, seed in ((14, 0.5, 1), (25, 0.3, 2), (9, 0.9, 3)):
        rng = random.Random(seed)
        edges = [(f"n{a:02}", f"n{b:02}") for a in range(n) for b in range(a + 1, n) if rng.random() < share]
        kinds = {f"n{a:02}": f"c{rng.randrange(3)}" for a in range(n)}
        cats = spark.createDataFrame(list(kinds.items()), "node string, category string")
        df = spark.createDataFrame(edges, "a string, b string")
        for least, most in ((2, 1), (3, 2), (4, 3)):
            want = {tuple(c.split("|")) for c in maximal_cliques(edges, least)}
            want = {c for c in want if len({kinds[x] for x in c}) >= most}
            found = [tuple(r.members) for r in graphs.cliques(df, least, cats, most).collect()]
            assert sorted(found) == sorted(want)
    assert graphs.cliques(spark.createDataFrame([], "a string, b string"), 2).count() == 0


def test_peeling_keeps_later_neighbours_few(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 399)]
    layer = {r.node: (r.layer, r.node) for r in graphs.peeled(spark.createDataFrame(edges, "a long, b long")).collect()}
    later: dict = {}
    for a, b in edges:
        first = min(a, b, key=layer.get)
        later[first] = later.get(first, 0) + 1
    assert len(layer) == 400 and max(later.values()) <= 8


def test_components_and_cliques(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102)]
    roots = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(31)) and roots[102] == 100
    k4 = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    got = {tuple(r.members) for r in graphs.cliques(spark.createDataFrame(k4, "a string, b string")).collect()}
    assert got == {("a", "b", "c", "d"), ("d", "e", "f")}


def test_bfs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r.node: r.hops for r in graphs.bfs(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_change_point_is_found():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(100, 0.5, 60), rng.normal(150, 0.5, 20)])
    e, _ = drift.run_lengths(x)
    assert e[59] > 30 and e[62] < 10
    assert np.allclose(drift.log_gamma(np.array([0.5, 1.0, 3.0, 10.5])), [math.lgamma(v) for v in (0.5, 1.0, 3.0, 10.5)], atol=1e-8)


def test_hidden_states_are_recovered():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = np.where(truth == 1, rng.normal(3, 0.5, 240), rng.normal(0, 0.5, 240))
    assert (drift.hmm_labels(x) == truth).mean() > 0.97


def test_wasserstein(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [3.0, 4.0, 5.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(drift.wasserstein(F.col("a"), F.col("b")).alias("same"), drift.wasserstein(F.col("a"), F.col("c")).alias("moved")).first()
    assert r.same == 0 and math.isclose(r.moved, 2.0)


def test_proximity_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 200), rng.uniform(-170, 170, 200), strict=True))]
    zns = [(i, float(a), float(b), float(r)) for i, (a, b, r) in enumerate(zip(rng.uniform(-60, 60, 20), rng.uniform(-150, 150, 20), rng.uniform(100, 1500, 20), strict=True))]
    got = {(r.p, r.z) for r in joins.proximity_join(spark.createDataFrame(pts, "p int, lat double, lon double"), spark.createDataFrame(zns, "z int, zone_lat double, zone_lon double, radius_km double")).collect()}

    def km(a, b, c, e):
        x = math.radians(e - b) * math.cos(math.radians((a + c) / 2))
        return 6371 * math.hypot(x, math.radians(c - a))

    assert got == {(p, z) for p, a, b in pts for z, c, e, r in zns if km(a, b, c, e) <= r}


def test_scalars(spark):
    df = spark.createDataFrame([('{"a": 1.5, "b": "x", "c": true}', "Société Générale S.A., Inc.", " 7d", "2024-03-01", "03/01/2024", "20240301")], "j string, n string, r string, d1 string, d2 string, d3 string")
    r = df.select(
        S.json_number(F.col("j"), "a").alias("a"), S.json_number(F.col("j"), "b").alias("b"), S.first_number(F.col("j"), ["b", "a"]).alias("f"), S.normalise_company(F.col("n")).alias("n"),
        S.relative_seconds(F.trim("r")).alias("r"), *[S.date_seconds(F.col(c)).alias(c) for c in ("d1", "d2", "d3")], S.chi2_even_tail(F.lit(7.5), 3).alias("chi"), S.symexp(S.symlog(F.lit(-12.5))).alias("s"),
        S.clamp(F.lit(float("nan")), -1, 1).alias("nan"), S.discretise(F.lit(-3.0), [0, 1]).alias("low"), S.magnitude_label(F.lit(7.2)).alias("m"),
    ).first()
    assert (r.a, r.b, r.f, r.r, r.nan, r.low, r.m) == (1.5, None, 1.5, 604_800, 0.0, 0, "MAJOR")
    assert r.n == "societe generale s a" and r.d1 == r.d2 == r.d3 == 1_709_251_200
    assert math.isclose(r.chi, math.exp(-3.75) * (1 + 3.75 + 3.75**2 / 2)) and math.isclose(r.s, -12.5)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.5), (7, 200, 0.01)])
def test_binomial_tail(spark, k, n, p):
    got = spark.createDataFrame([(float(k), float(n), p)], "k double, n double, p double").select(S.binomial_upper("k", "n", "p").alias("x")).first().x
    assert math.isclose(got, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), rel_tol=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_vector_search(spark, block):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 4))
    m[3] = m[4] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.nearest(df, df.where("vec_id % 20 = 0"), 5, block=block).collect()
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in (0, 20, 40):
        sims = np.round(unit @ unit[q], 6)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-sims[i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: (-r.sim, r.id))] == want


def test_the_shared_folder(spark, monkeypatch):
    """What a session has written can be deleted; a machine-local folder is refused where executors are elsewhere."""
    import os
    from types import SimpleNamespace

    from tessella import session

    session.written(spark.range(3), "x").count()
    paths = [p.removeprefix("file://") for p in session._written[spark.sparkContext.applicationId]]
    assert all(map(os.path.isdir, paths[-1:]))
    assert session.clear(spark) == len(paths) and not any(map(os.path.isdir, paths))
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(applicationId="far", master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(far)
    far.conf.get = lambda k, d: "hdfs:///shared/"
    assert session.shared_dir(far) == "hdfs:///shared"


def test_topology_against_dense_solvers(spark):
    rng = np.random.default_rng(3)
    rows, dense = [], {}
    for g, n in (("a", 9), ("b", 14), ("c", 2), ("d", 6), ("ties", 8)):
        x = rng.random((n, 2))
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) if g != "ties" else np.where(np.eye(n), 0.0, 0.5 + (np.add.outer(np.arange(n), np.arange(n)) % 2) * 0.25)
        dense[g] = dist
        rows += [(g, f"p{i:02}", f"p{j:02}", float(dist[i, j])) for i in range(n) for j in range(n) if i != j]
    df = spark.createDataFrame(rows, "g string, a string, b string, dist double").cache()
    for epsilon in (0.35, 0.01):
        got = {r.g: r.gap for r in topology.spectral_gap(df, epsilon).collect()}
        for g, dist in dense.items():
            near = (dist < epsilon) & ~np.eye(len(dist), dtype=bool)
            want = np.sort(np.linalg.eigvalsh(np.diag(near.sum(1)) - near))[1] if len(dist) > 2 else 0.0
            assert got[g] == pytest.approx(max(0.0, want), abs=2e-3)  # isolated points and pieces give 0
    trees = {r.g: r.deaths for r in topology.persistence(df).collect()}
    for g, dist in dense.items():
        root, tree = list(range(len(dist))), []
        for w, i, j in sorted((dist[i, j], i, j) for i in range(len(dist)) for j in range(i + 1, len(dist))):
            if root[i] != root[j]:
                tree.append(w)
                root = [root[i] if r == root[j] else r for r in root]
        assert trees[g] == pytest.approx(tree)
    d = spark.createDataFrame([([0.1, 0.5], [0.2]), ([], []), ([1.0], [0.25, 0.5, 3.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in d.select(topology.matching_distance(F.col("a"), F.col("b"))).collect()] == [0.3, 0.0, 2.0]


def test_keyed_writes_touch_only_their_partitions(spark, tmp_path):
    from tessella.sources.tables import PartitionedTable

    rows = [(p, k, 1, f"{p}{k}") for p in ("a", "b", "c", None, "d=/ e") for k in range(20)]
    path = str(tmp_path / "t")
    t = PartitionedTable.create(spark.createDataFrame(rows, "p string, k int, v int, x string"), ["p"], path)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}

    def of(*names):
        return {f: t for f, t in files().items() if f.parent.name in names}

    before = files()
    new = spark.createDataFrame([("b", 3, 2, "newer"), ("b", 4, 0, "older"), ("b", 50, 1, "added"), ("b", 3, 1, "equal loses"), (None, 7, 2, "of none"), ("z", 1, 1, "fresh"), ("a", 1, 9, "bad")], "p string, k int, v int, x string")
    for _ in range(2):  # once more changes nothing
        t.upsert(new, ["p", "k"], "v", valid=F.col("x") != "bad")
        want = {(p, k): x for p, k, _, x in rows} | {("b", 3): "newer", ("b", 50): "added", (None, 7): "of none", ("z", 1): "fresh"}
        assert sorted(((r.p, r.k, r.x) for r in t.read().collect()), key=str) == sorted(((p, k, x) for (p, k), x in want.items()), key=str)
    kept = {f: m for f, m in before.items() if f.parent.name in ("p=a", "p=c") or "e" in f.parent.name and "d" in f.parent.name and "DEFAULT" not in f.parent.name}
    assert len(kept) >= 3 and kept.items() <= files().items()
    others = {f: m for f, m in files().items() if f.parent.name not in ("p=c", "p=b")}
    assert t.delete(((F.col("p") == "c") & (F.col("k") < 5)) | ((F.col("p") == "b"))) == 26
    assert not of("p=b") and not (tmp_path / "t" / "p=b").exists() and {r.k for r in t.read().where("p = 'c'").collect()} == set(range(5, 20))
    assert others.items() <= files().items()
    assert t.delete(F.col("k") > 1000) == 0
    others = {f: m for f, m in files().items() if f.parent.name != "p=c"}
    assert t.update((F.col("p") == "c") & (F.col("k") > 17), v=F.lit(5)) == 2
    assert {(r.k, r.v) for r in t.read().where("p = 'c' and k > 16").collect()} == {(17, 1), (18, 5), (19, 5)} and others.items() <= files().items()
    with pytest.raises(ValueError):
        t.upsert(new, ["k"], "v")
    with pytest.raises(ValueError):
        t.update(F.col("k") > 0, p=F.lit("q"))


def test_sample_distances(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(round(x, 2)) if k != "flat" else 1.0, bool(rng.random() < 0.3), bool(rng.random() < 0.8)) for k, n in (("many", 200), ("few", 7), ("flat", 40)) for x in rng.normal(0, 2, n)]
    rows += [("one", 1.0, True, False), ("one", 4.0, False, True), ("none", 1.0, False, True), ("many", None, True, True)]
    df = spark.createDataFrame(rows, "k string, x double, a boolean, b boolean")
    arrays = df.where("x is not null").groupBy("k").agg(F.collect_list(F.when(F.col("a"), F.col("x"))).alias("a"), F.collect_list(F.when(F.col("b"), F.col("x"))).alias("b"))
    want = {r.k: r.w for r in arrays.where("size(a) > 0 and size(b) > 0").select("k", drift.wasserstein(F.col("a"), F.col("b")).alias("w")).collect()}
    for buckets in (2, 64):
        got = {r.k: r.w1 for r in drift.sample_distances(df, ["k"], "x", F.col("a"), F.col("b"), buckets).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert want["one"] == 3.0 and want["flat"] == 0.0


def test_sample_distances_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("k"), (F.col("id") / 1e6).alias("x"), (F.col("id") % 2 == 0).alias("a"), (F.col("id") >= 500_000).alias("b"))
    assert drift.sample_distances(df, ["k"], "x", F.col("a"), F.col("b")).first().w1 == pytest.approx(0.25, abs=1e-5)
