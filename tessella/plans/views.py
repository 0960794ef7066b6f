"""Views that bind the operators to the test tables: DataFrames, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(col: str):
    return F.to_date(F.col(col))


def obs(spark, d) -> DataFrame:
    """The fact table: one observation per event. Times are cast once from timestamp without zone (UTC)."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("obs_id"), F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"), "value", "props",
    )


def entities(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity_id"), F.lit("customer").alias("entity_type"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("entity_id"), F.lit("region").alias("entity_type"), F.col("r_name").alias("name"))
    b = table(spark, d, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("entity_id"), F.lit("brand").alias("entity_type"), F.col("p_brand").alias("name")).distinct()
    return c.union(s).union(n).union(r).union(b)


def links(spark, d) -> DataFrame:
    def link(df, a, b, kind, confidence):
        return df.select(a.alias("entity_a"), b.alias("entity_b"), F.lit(kind).alias("link_type"), F.lit(confidence).alias("confidence"))

    tag = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    made = (
        li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).groupBy("p_brand", "s_nationkey").agg(F.sum("l_quantity").alias("q"))
        .withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("q"), "s_nationkey"))).where("k <= 3")
    )
    return (
        link(table(spark, d, "customer"), tag("customer", "c_custkey"), tag("nation", "c_nationkey"), "headquartered_in", 0.9)
        .union(link(s, tag("supplier", "s_suppkey"), tag("nation", "s_nationkey"), "located_in", 0.8))
        .union(link(table(spark, d, "nation"), tag("nation", "n_nationkey"), tag("region", "n_regionkey"), "part_of", 1.0))
        .union(link(made, tag("brand", "p_brand"), tag("nation", "s_nationkey"), "produced_in", 0.7))
    )


def obs_dup(spark, d) -> DataFrame:
    """Observations with repeated (entity, time): the shipped lines of a brand."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat(F.lit("brand:"), "p_brand").alias("entity_id"), F.lit("lineitem").alias("source"), F.col("l_shipdate").cast("timestamp").alias("ts"), key.alias("id"), F.col("l_quantity").alias("value")
    )


def bars(spark, d) -> DataFrame:
    """Daily bars of each brand."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    daily = (
        li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("brand"), day("l_shipdate").alias("d"))
        .agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.round(F.max(unit), 6).alias("high"), F.round(F.min(unit), 6).alias("low"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))
    )
    w = Window.partitionBy("brand").orderBy("d")
    return daily.withColumn("ret", F.round(F.log(F.col("close") / F.lag("close").over(w)), 9))


def positioning(spark, d) -> DataFrame:
    """Weekly long and short positions of each brand."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    long = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    return (
        li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("brand"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"))
        .agg(long.alias("longs"), (F.sum("l_quantity") - long).alias("shorts"), F.sum("l_quantity").alias("oi"))
    )


def country_events(spark, d) -> DataFrame:
    """Scored events of nations: score from -10 to 10, quad class 1 to 4."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.concat(F.lit("nation:"), "s_nationkey").alias("entity_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.round(F.col("l_discount") * 200 - 10, 4).alias("score"),
        (F.col("l_linenumber") % 4 + 1).alias("quad"), F.col("l_orderkey").alias("event_key"), F.col("l_linenumber").alias("event_line"), F.col("l_partkey").alias("event_part"),
    )


def trades(spark, d) -> DataFrame:
    """Prediction-market trades: wallet, market, side, price, size, and whether the market resolved in favour."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("customer:"), "o_custkey").alias("wallet"), (F.col("l_partkey") % 200).alias("market"), F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 4).alias("price"), F.col("l_extendedprice").alias("usdc"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_partkey") % 3 != 0).alias("resolved"), (((F.col("l_partkey") + F.col("l_linenumber")) % 2 == 0)).alias("correct"),
    )


def series(spark, d) -> DataFrame:
    """Daily sums as named signals with a category: by nation of the supplier, by market segment and by order priority."""
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    by_nation = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.concat(F.lit("ship.nation:"), "s_nationkey").alias("signal"), day("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("value")).withColumn("category", F.lit("logistics"))
    by_segment = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.concat(F.lit("orders."), "c_mktsegment").alias("signal"), day("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("value")).withColumn("category", F.lit("demand"))
    by_priority = o.groupBy(F.concat(F.lit("priority."), "o_orderpriority").alias("signal"), day("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("value")).withColumn("category", F.lit("urgency"))
    by_flag = li.groupBy(F.concat(F.lit("flag."), "l_returnflag").alias("signal"), day("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("value")).withColumn("category", F.lit("returns"))
    return by_nation.unionByName(by_segment).unionByName(by_priority).unionByName(by_flag)


SQL: dict[str, str] = {
    "obs": "SELECT event_id AS obs_id, 'customer:' || user_id AS entity_id, event_type AS source, ts, value, props FROM events",
    "entities": """SELECT 'customer:' || c_custkey AS entity_id, 'customer' AS entity_type, c_name AS name FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'brand', p_brand FROM part""",
    "made_in": """SELECT p_brand, s_nationkey FROM (SELECT p_brand, s_nationkey, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, s_nationkey) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE k <= 3""",
    "links": """SELECT 'customer:' || c_custkey AS entity_a, 'nation:' || c_nationkey AS entity_b, 'headquartered_in' AS link_type, CAST(0.9 AS DOUBLE) AS confidence FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 0.8 FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 1.0 FROM nation
        UNION ALL SELECT 'brand:' || p_brand, 'nation:' || s_nationkey, 'produced_in', 0.7 FROM made_in""",
    "obs_dup": """SELECT 'brand:' || p_brand AS entity_id, 'lineitem' AS source, l_shipdate AS ts,
        {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_shipdate, 'f': l_quantity, 'g': l_extendedprice} AS id, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars0": """SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS d, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, round(max(l_extendedprice / l_quantity), 6) AS high,
        round(min(l_extendedprice / l_quantity), 6) AS low, sum(l_quantity) AS volume, count(*) AS trades FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "bars": "SELECT *, round(ln(close / lag(close) OVER (PARTITION BY brand ORDER BY d)), 9) AS ret FROM bars0",
    "positioning": """SELECT p_brand AS brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS longs,
        sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS shorts, sum(l_quantity) AS oi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "country_events": """SELECT 'nation:' || s_nationkey AS entity_id, l_shipdate AS ts, round(l_discount * 200 - 10, 4) AS score, l_linenumber % 4 + 1 AS quad,
        l_orderkey AS event_key, l_linenumber AS event_line, l_partkey AS event_part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "trades": """SELECT 'customer:' || o_custkey AS wallet, l_partkey % 200 AS market, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side, round(l_discount * 5 + l_tax * 5, 4) AS price,
        l_extendedprice AS usdc, l_shipdate AS ts, l_partkey % 3 <> 0 AS resolved, (l_partkey + l_linenumber) % 2 = 0 AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "series": """SELECT 'ship.nation:' || s_nationkey AS signal, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS value, 'logistics' AS category FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
        UNION ALL SELECT 'orders.' || c_mktsegment, CAST(o_orderdate AS DATE), CAST(count(*) AS DOUBLE), 'demand' FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
        UNION ALL SELECT 'priority.' || o_orderpriority, CAST(o_orderdate AS DATE), CAST(count(*) AS DOUBLE), 'urgency' FROM orders GROUP BY 1, 2
        UNION ALL SELECT 'flag.' || l_returnflag, CAST(l_shipdate AS DATE), sum(l_quantity), 'returns' FROM lineitem GROUP BY 1, 2""",
}
