"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vectors import nearest
from ..registry import query
from .series import WZ, event_scores, zsql
from .views import bars, entities, links, obs, positioning, series, table


@query("SELECT obs_id, value FROM obs ORDER BY ts DESC, obs_id LIMIT 100")
def top_latest_n(spark, d):
    return obs(spark, d).orderBy(F.desc("ts"), "obs_id").limit(100).select("obs_id", "value")


def diversified(df: DataFrame, bucket: list[str], score: str, tie: str, n: int, per_bucket: int = 2) -> DataFrame:
    """n rows: the best of each bucket first, then the second best, up to per_bucket; then the rest by score."""
    k = F.row_number().over(Window.partitionBy(*bucket).orderBy(F.desc(score), tie))
    ranked = df.withColumn("_pass", F.least(k, F.lit(per_bucket + 1)))
    return ranked.orderBy("_pass", F.desc(score), tie).limit(n).drop("_pass")


@query(f"""WITH z AS (SELECT obs_id, entity_id, source, abs(round({zsql('value', WZ, 19)}, 6)) AS z FROM obs), k AS (SELECT *, least(row_number() OVER (PARTITION BY source, entity_id ORDER BY z DESC, obs_id), 3) AS p FROM z WHERE z >= 1)
SELECT obs_id, entity_id, source, z FROM k ORDER BY p, z DESC, obs_id LIMIT 60""")
def top_diversified_n(spark, d):
    z = event_scores(spark, d).select("obs_id", "entity_id", "source", F.abs(F.round("z", 6)).alias("z")).where("z >= 1")
    return diversified(z, ["source", "entity_id"], "z", "obs_id", 60)


CLUSTER = """f AS (SELECT l_partkey % 300 AS ticker, l_suppkey AS insider, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT a.ticker, a.d AS anchor, b.insider, b.v, row_number() OVER (PARTITION BY a.ticker, a.d, b.insider ORDER BY b.d) AS k FROM (SELECT DISTINCT ticker, d FROM f) a JOIN f b ON b.ticker = a.ticker AND b.d BETWEEN a.d AND a.d + 14),
c AS (SELECT ticker, anchor, count(*) AS insiders, round(sum(v), 4) AS total FROM p WHERE k = 1 GROUP BY 1, 2)"""


def clusters(spark, d, least: int):
    """For each filing day of a ticker the distinct insiders of the next 14 days, the first filing of each counted.

    A filing is the first of its insider for the anchors after the insider's filing before and at most 14 days back, so
    rows are shuffled once by insider and only sums by anchor again.
    """
    day = F.to_date("l_shipdate")
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("ticker"), F.col("l_suppkey").alias("insider"), day.alias("d"), F.col("l_extendedprice").alias("v"))
    f = rows.where("ticker is not null and d is not null").repartition("ticker", "insider").groupBy("ticker", "insider", "d").agg(F.min("v").alias("v"))
    before = F.lag("d").over(Window.partitionBy("ticker", "insider").orderBy("d"))
    anchors = F.sequence(F.greatest(F.date_add(before, 1), F.date_sub("d", 14)), F.col("d"))
    p = f.select("ticker", "d", "v", anchors.alias("anchors")).select("ticker", "d", "v", F.explode("anchors").alias("anchor"))
    c = p.groupBy("ticker", "anchor").agg(F.count("*").alias("insiders"), F.round(F.sum("v"), 4).alias("total"), F.max(F.col("d") == F.col("anchor")).alias("filed"))
    return c.where(F.col("filed") & (F.col("insiders") >= least)).drop("filed")


@query(f"WITH {CLUSTER} SELECT ticker, CAST(anchor AS VARCHAR) AS anchor, insiders, total FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(insiders * total, 2) DESC, c.anchor) AS k FROM c WHERE insiders >= 3) WHERE k = 1")
def top_best_window_cluster(spark, d):
    return best_cluster(clusters(spark, d, 3), F.col("insiders") * F.col("total"))


def best_cluster(c, score):
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.round(score, 2).desc(), "anchor"))
    return c.withColumn("k", k).where("k = 1").select("ticker", F.col("anchor").cast("string").alias("anchor"), "insiders", "total")


@query(f"WITH {CLUSTER} SELECT ticker, CAST(anchor AS VARCHAR) AS anchor, insiders, total FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(insiders * total * CASE WHEN ticker % 2 = 0 THEN 1.5 ELSE 1 END, 2) DESC, c.anchor) AS k FROM c WHERE insiders >= 2) WHERE k = 1")
def top_best_sell_cluster(spark, d):
    return best_cluster(clusters(spark, d, 2), F.col("insiders") * F.col("total") * F.when(F.col("ticker") % 2 == 0, 1.5).otherwise(1.0))


@query("SELECT brand, CAST(week AS VARCHAR) AS week, longs - shorts AS flow FROM positioning ORDER BY abs(longs - shorts) DESC, brand, positioning.week LIMIT 40")
def top_rank_snapshots(spark, d):
    p = positioning(spark, d).withColumn("flow", F.col("longs") - F.col("shorts"))
    return p.orderBy(F.desc(F.abs("flow")), "brand", "week").limit(40).select("brand", F.col("week").cast("string").alias("week"), "flow")


@query("SELECT brand, round(sum(ret * volume), 4) AS contribution FROM bars GROUP BY 1 ORDER BY abs(round(sum(ret * volume), 4)) DESC, brand LIMIT 10")
def top_instruments(spark, d):
    c = bars(spark, d).groupBy("brand").agg(F.round(F.sum(F.col("ret") * F.col("volume")), 4).alias("contribution"))
    return c.orderBy(F.desc(F.abs("contribution")), "brand").limit(10)


@query("""WITH s AS (SELECT signal, category, round(abs((arg_max(value, d) - avg(value)) / stddev_samp(value)), 6) AS z FROM series GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY z DESC, signal) AS k FROM s),
x AS (SELECT a.signal AS sa, b.signal AS sb FROM k a JOIN k b ON a.category < b.category AND a.k <= 2 AND b.k <= 2 UNION SELECT a.signal, b.signal FROM k a JOIN k b ON a.category = b.category AND a.signal < b.signal AND a.z > 1.5 AND b.z > 1.5) SELECT * FROM x""")
def top_pairs(spark, d):
    z = F.round(F.abs((F.max_by("value", "d") - F.avg("value")) / F.stddev_samp("value")), 6)
    s = series(spark, d).groupBy("signal", "category").agg(z.alias("z"))
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("z"), "signal")))
    side = lambda df, x: df.select(F.col("signal").alias(f"s{x}"), F.col("category").alias(f"c{x}"))
    best, odd = k.where("k <= 2"), k.where("z > 1.5")
    across = side(best, "a").join(F.broadcast(side(best, "b")), F.col("ca") < F.col("cb"))  # two signals of each category
    within = side(odd, "a").join(side(odd, "b"), (F.col("ca") == F.col("cb")) & (F.col("sa") < F.col("sb")))
    return across.select("sa", "sb").union(within.select("sa", "sb")).distinct()


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.q, b.vec_id, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM q JOIN embeddings b ON b.vec_id <> q.q),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS k FROM s) SELECT q, vec_id, sim FROM k WHERE k <= 5""")
def top_embedding_k(spark, d):
    """The stated query set (every id divisible by 20) against all vectors, in blocks of queries."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 5).withColumnRenamed("id", "vec_id")


@query("SELECT entity_a AS x, entity_b AS y FROM links WHERE link_type = 'part_of' UNION SELECT entity_b, entity_a FROM links WHERE link_type = 'part_of'")
def set_union_links(spark, d):
    k = links(spark, d).where("link_type = 'part_of'")
    return k.select(F.col("entity_a").alias("x"), F.col("entity_b").alias("y")).union(k.select("entity_b", "entity_a")).distinct()


@query("""WITH u AS (SELECT signal, d, value, 2 AS p FROM series WHERE category = 'demand' UNION ALL SELECT replace(signal, 'priority.', 'orders.'), d, value, 1 FROM series WHERE category = 'urgency'), k AS (SELECT *, row_number() OVER (PARTITION BY signal, d ORDER BY p DESC) AS k FROM u) SELECT signal, CAST(d AS VARCHAR) AS dd, value FROM k WHERE k = 1""")
def set_union_types(spark, d):
    s = series(spark, d)
    u = s.where("category = 'demand'").select("signal", "d", "value", F.lit(2).alias("p")).unionByName(s.where("category = 'urgency'").select(F.expr("replace(signal, 'priority.', 'orders.')").alias("signal"), "d", "value", F.lit(1).alias("p")))
    return u.groupBy("signal", "d").agg(F.max_by("value", "p").alias("value")).select("signal", F.col("d").cast("string").alias("dd"), "value")


@query("""WITH a AS (SELECT DISTINCT entity_id, source FROM obs WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT entity_id, source FROM obs WHERE ts >= TIMESTAMP '2024-01-15')
SELECT 'gone' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_diff_records(spark, d):
    late = F.max(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    early = F.max(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    g = obs(spark, d).groupBy("entity_id", "source").agg(early.alias("a"), late.alias("b"))
    n = g.agg(F.count_if(F.col("a") & ~F.col("b")).alias("gone"), F.count_if(~F.col("a") & F.col("b")).alias("new"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return n.select(F.explode(F.map_from_arrays(F.array(F.lit("gone"), F.lit("new"), F.lit("both")), F.array("gone", "new", "both"))).alias("side", "n"))


@query("""WITH c AS (SELECT p_brand, list(DISTINCT p_type) AS ts FROM part WHERE p_size < 6 GROUP BY 1), r AS (SELECT list(DISTINCT p_type) AS ref FROM part WHERE p_size > 40) SELECT p_brand, len(list_intersect(ts, ref)) / len(ts) > 0.5 AS overlaps FROM c, r""")
def set_type_overlap(spark, d):
    p = table(spark, d, "part")
    seen = p.where("p_size > 40").select("p_type").distinct().withColumn("hit", F.lit(1))
    c = p.where("p_size < 6").select("p_brand", "p_type").distinct().join(seen, "p_type", "left")
    return c.groupBy("p_brand").agg((F.count("hit") / F.count("*") > 0.5).alias("overlaps"))


@query("""WITH a AS (SELECT brand, d, close AS x FROM bars WHERE trades >= 2), b AS (SELECT brand, d, high AS y FROM bars WHERE volume >= 40), j AS (SELECT a.brand, x, y FROM a JOIN b ON a.brand = b.brand AND a.d = b.d),
k AS (SELECT brand, x, y, rank() OVER (PARTITION BY brand ORDER BY x) + (count(*) OVER (PARTITION BY brand, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY brand ORDER BY y) + (count(*) OVER (PARTITION BY brand, y) - 1) / 2.0 AS ry FROM j)
SELECT brand, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 4) AS mad FROM k GROUP BY 1""")
def set_lookup_intersection(spark, d):
    b = bars(spark, d)
    j = b.where("trades >= 2").select("brand", "d", F.col("close").alias("x")).join(b.where("volume >= 40").select("brand", "d", F.col("high").alias("y")), ["brand", "d"])
    k = average_rank(average_rank(j, ["brand"], "x", "rx"), ["brand"], "y", "ry")
    return k.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mad"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties share their mean."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


@query("WITH s AS (SELECT DISTINCT source, entity_id FROM obs) SELECT a.source AS s1, b.source AS s2, count(*) AS n FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.source < b.source GROUP BY 1, 2")
def set_source_pair_overlap(spark, d):
    """Sources of an entity as a sorted set, pairs from it: no self join."""
    e = obs(spark, d).groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
    pairs = e.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as s1, y as s2))))")).alias("p"))
    return pairs.groupBy("p.s1", "p.s2").agg(F.count("*").alias("n"))


@query("SELECT entity_type, min(name) AS first_name FROM entities GROUP BY 1")
def top_first_by_type(spark, d):
    return entities(spark, d).groupBy("entity_type").agg(F.min("name").alias("first_name"))
