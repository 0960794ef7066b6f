"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import query
from ..sources import store
from .views import country_events, entities, links, obs, positioning, series, table


@query("SELECT obs_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM obs")
def prj_json_field(spark, d):
    return obs(spark, d).select("obs_id", S.json_number(F.col("props"), "k").alias("x"))


@query("SELECT obs_id, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS x FROM obs")
def prj_first_numeric(spark, d):
    return obs(spark, d).select("obs_id", S.first_number(F.col("props"), ["missing", "k"]).alias("x"))


@query("SELECT obs_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS price FROM obs WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0")
def prj_positive_price(spark, d):
    return obs(spark, d).select("obs_id", S.positive(S.json_number(F.col("props"), "k")).alias("price")).where("price is not null")


@query("SELECT count(*) AS kept, epoch_us(max(ts)) AS reference_us FROM obs WHERE ts <= TIMESTAMP '2024-01-15' + INTERVAL 1 DAY")
def prj_plausible_time(spark, d):
    sane = obs(spark, d).where(F.col("ts") <= F.expr("timestamp '2024-01-15' + interval 1 day"))
    return sane.agg(F.count("*").alias("kept"), F.unix_micros(F.max("ts")).alias("reference_us"))


LINKED = "k AS (SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS created_at FROM orders)"


@query(f"WITH {LINKED} SELECT a, b FROM k WHERE created_at IS NULL OR created_at <= TIMESTAMP '1996-06-30'")
def prj_as_of_links(spark, d):
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("created_at"))
    return k.where(S.known_by(F.col("created_at"), F.lit("1996-06-30").cast("timestamp_ntz"))).select("a", "b")


@query("SELECT entity_id, count(*) FILTER (WHERE quad >= 3) AS conflict, count(*) FILTER (WHERE quad <= 2) AS cooperation FROM country_events WHERE score <= -2 GROUP BY 1")
def prj_event_filter(spark, d):
    e = country_events(spark, d).where("score <= -2")
    return e.groupBy("entity_id").agg(F.count_if(F.col("quad").isin(3, 4)).alias("conflict"), F.count_if(F.col("quad").isin(1, 2)).alias("cooperation"))


@query("""WITH t AS (SELECT p_type, sum(p_retailprice) AS oi FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(oi, 4) DESC, p_type) AS k FROM t)
SELECT p_type, round(oi, 4) AS oi FROM r WHERE k <= 10 OR p_type LIKE '%BRASS%'""")
def prj_contract_filter(spark, d):
    t = table(spark, d, "part").groupBy("p_type").agg(F.round(F.sum("p_retailprice"), 4).alias("oi"))
    top = t.orderBy(F.desc("oi"), "p_type").limit(10)
    mapped = t.where(F.lower("p_type").contains("brass"))
    return top.unionByName(mapped.join(top.select("p_type"), "p_type", "left_anti"))


@query("""SELECT brand, CAST(week AS VARCHAR) AS week, longs - shorts AS net, CASE WHEN oi = 0 THEN 0 ELSE round((longs - shorts) / oi * 100, 2) END AS net_pct,
  round((longs - shorts) - lag(longs - shorts) OVER (PARTITION BY brand ORDER BY positioning.week), 6) AS flow FROM positioning""")
def prj_position_signals(spark, d):
    net = F.coalesce("longs", F.lit(0.0)) - F.coalesce("shorts", F.lit(0.0))
    p = positioning(spark, d).withColumn("net", net)
    return p.select(
        "brand", F.col("week").cast("string").alias("week"), "net", F.when(F.col("oi") == 0, 0.0).otherwise(F.round(F.col("net") / F.col("oi") * 100, 2)).alias("net_pct"),
        F.round(F.col("net") - F.lag("net").over(Window.partitionBy("brand").orderBy(positioning_week())), 6).alias("flow"),
    )


def positioning_week():
    return F.col("week").cast("date")


@query("SELECT event_key, event_line, event_part, score FROM country_events WHERE score <= -5")
def prj_goldstein_gate(spark, d):
    return country_events(spark, d).where(F.expr("try_cast(score as double)") <= -5).select("event_key", "event_line", "event_part", "score")


RULES_SQL = """CASE WHEN NOT regexp_matches(p_name, '^[a-z]') THEN 'name;' ELSE '' END || CASE WHEN NOT (p_size >= 5) THEN 'version;' ELSE '' END || CASE WHEN NOT (p_retailprice BETWEEN 0 AND 1500) THEN 'range;' ELSE '' END"""


@query(f"SELECT p_partkey, rtrim({RULES_SQL}, ';') AS broken, ({RULES_SQL}) = '' AS valid FROM part")
def prj_validity_rules(spark, d):
    broken = store.messages({"name": F.col("p_name").rlike("^[a-z]"), "version": F.col("p_size") >= 5, "range": F.col("p_retailprice").between(0, 1500)})
    return table(spark, d, "part").select("p_partkey", broken.alias("b")).select("p_partkey", F.array_join("b", ";").alias("broken"), (F.size("b") == 0).alias("valid"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'variance' ELSE '' END AS broken FROM supplier")
def prj_belief_rules(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.array_join(store.messages({"mean": ~F.isnan("s_acctbal"), "variance": F.col("s_acctbal") >= 0}), ";").alias("broken"))


@query("SELECT o_orderkey FROM orders WHERE date_trunc('week', o_orderdate) = date_trunc('week', DATE '1996-05-15')")
def prj_iso_week_filter(spark, d):
    return table(spark, d, "orders").where("date_trunc('week', o_orderdate) = date_trunc('week', timestamp '1996-05-15')").select("o_orderkey")


@query("SELECT obs_id, epoch(TIMESTAMP '2024-01-20') - epoch(ts) > 604800 AS stale FROM obs")
def prj_is_stale(spark, d):
    return obs(spark, d).select("obs_id", S.is_stale(F.col("ts"), 7 * 86_400, F.lit("2024-01-20").cast("timestamp")).alias("stale"))


@query("SELECT source, count(*) AS seen, count(*) FILTER (WHERE source < 'p' OR obs_id % 4 = 0) AS kept FROM obs GROUP BY 1")
def prj_source_cap_sampling(spark, d):
    keep = (F.col("source") < "p") | (F.col("obs_id") % 4 == 0)  # floor sources whole, the rest thinned by key
    return obs(spark, d).groupBy("source").agg(F.count("*").alias("seen"), F.count_if(keep).alias("kept"))


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM obs GROUP BY 1")
def prj_training_mix(spark, d):
    counts = obs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))  # one row


@query("SELECT DISTINCT link_type FROM links WHERE link_type NOT IN ('part_of', 'located_in') UNION ALL SELECT DISTINCT entity_type FROM entities WHERE entity_type NOT IN ('nation', 'region')")
def prj_schema_drift(spark, d):
    known = spark.createDataFrame([(x,) for x in ("part_of", "located_in", "nation", "region")], "link_type string")
    seen = links(spark, d).select("link_type").distinct().union(entities(spark, d).select("entity_type").distinct())
    return seen.join(F.broadcast(known), "link_type", "left_anti")


@query("""SELECT 'convergence.' || source || '.' || strftime(ts, '%Y-%m-%d') AS name, round(max(value), 6) AS value, count(*) AS n FROM obs GROUP BY 1""")
def prj_signal_rows(spark, d):
    name = F.concat_ws(".", F.lit("convergence"), "source", F.date_format("ts", "yyyy-MM-dd"))
    return obs(spark, d).groupBy(name.alias("name")).agg(F.round(F.max("value"), 6).alias("value"), F.count("*").alias("n"))


@query("SELECT signal, CAST(d AS VARCHAR) AS d, CASE WHEN category IN ('demand') THEN -value ELSE value END AS stress FROM series")
def prj_direction_normalise(spark, d):
    return series(spark, d).select("signal", F.col("d").cast("string").alias("d"), S.flipped(F.col("value"), F.col("category") == "demand").alias("stress"))
