"""Beliefs, regimes and states: versioned distributions over variables, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from .views import bars, links, obs, series, table

BELIEFS = """bc AS (SELECT o_custkey % 40 AS variable, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'v0' ELSE 'v1' END AS version, o_orderpriority AS state, count(*) AS c FROM orders GROUP BY 1, 2, 3),
be AS (SELECT variable, version, state, (c + 1.0) / (sum(c) OVER (PARTITION BY variable, version) + 5.0) AS p FROM bc)"""


def beliefs(spark, d):
    """variable, version, state, p: smoothed shares of the states."""
    version = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "v0").otherwise("v1")
    c = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("variable"), version.alias("version"), F.col("o_orderpriority").alias("state")).agg(F.count("*").alias("c"))
    return c.select("variable", "version", "state", ((F.col("c") + 1.0) / (F.sum("c").over(Window.partitionBy("variable", "version")) + 5.0)).alias("p"))


@query(f"WITH {BELIEFS} SELECT variable, version, state, round(p, 8) AS p FROM be WHERE variable < 10 AND version = 'v1'")
def src_read_beliefs(spark, d):
    return beliefs(spark, d).where("variable < 10 and version = 'v1'").withColumn("p", F.round("p", 8))


@query(f"WITH {BELIEFS} SELECT a.variable, round(sum(a.p * ln(a.p / b.p)), 7) AS kl FROM be a JOIN be b ON a.variable = b.variable AND a.state = b.state AND a.version = 'v1' AND b.version = 'v0' GROUP BY 1")
def agg_belief_shift(spark, d):
    """KL of the later version from the earlier one, by one pivot of the versions."""
    w = beliefs(spark, d).groupBy("variable", "state").pivot("version", ["v0", "v1"]).agg(F.max("p")).where("v0 is not null and v1 is not null")
    return w.groupBy("variable").agg(F.round(F.sum(F.col("v1") * F.log(F.col("v1") / F.col("v0"))), 7).alias("kl"))


@query("""WITH g AS (SELECT o_custkey % 40 AS variable, var_samp(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS a, var_samp(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1) SELECT variable, round(0.5 * ln(a / b), 6) AS sharpening FROM g WHERE a > 0 AND b > 0""")
def agg_belief_sharpening(spark, d):
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    part = lambda c: F.var_samp(F.when(c, F.col("o_totalprice")))
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("variable")).agg(part(~late).alias("a"), part(late).alias("b")).where("a > 0 and b > 0")
    return g.select("variable", F.round(0.5 * F.log(F.col("a") / F.col("b")), 6).alias("sharpening"))


REGIME = """dr AS (SELECT d, arg_max(signal, {'v': value, 's': signal}) AS label FROM series WHERE category = 'urgency' GROUP BY 1), l2 AS (SELECT *, row_number() OVER (ORDER BY dr.d DESC) AS k FROM dr),
cr AS (SELECT max(label) FILTER (WHERE k = 1) AS regime, max(label) FILTER (WHERE k = 1) <> max(label) FILTER (WHERE k = 2) AS changed, max(d) FILTER (WHERE label <> (SELECT label FROM l2 WHERE k = 1)) AS other, max(d) AS last FROM l2)"""


def current_regime(spark, d):
    """The latest arg-max state, whether it has just changed, and for how many days it has held. One row per day comes in."""
    g = series(spark, d).where("category = 'urgency'").groupBy("d").agg(F.max_by("signal", F.struct("value", "signal")).alias("label"))
    x = g.agg(F.max_by("label", "d").alias("regime"), F.max("d").alias("last"), F.sort_array(F.collect_list(F.struct("d", "label")), asc=False).alias("xs"))
    other = F.array_max(F.transform(F.filter("xs", lambda r: r["label"] != F.col("regime")), lambda r: r["d"]))
    return x.select("regime", (F.col("xs")[1]["label"] != F.col("regime")).alias("changed"), F.date_diff("last", other).cast("long").alias("stable_days"))


@query(f"WITH {REGIME} SELECT regime, changed, (last - other)::BIGINT AS stable_days FROM cr")
def agg_current_regime(spark, d):
    return current_regime(spark, d)


@query(f"WITH {REGIME} SELECT changed AS high_change, CASE WHEN changed THEN 0.8 ELSE 1.0 END::DOUBLE AS prior_decay, CASE WHEN last - other < 3 THEN 0.7 ELSE 1.0 END::DOUBLE AS trust FROM cr")
def agg_regime_scalars(spark, d):
    return current_regime(spark, d).select(F.col("changed").alias("high_change"), F.when(F.col("changed"), 0.8).otherwise(1.0).alias("prior_decay"), F.when(F.col("stable_days") < 3, 0.7).otherwise(1.0).alias("trust"))


BIC = """xy AS (SELECT o_orderstatus AS y, o_orderpriority AS x, count(*) AS c FROM orders GROUP BY 1, 2), nx AS (SELECT x, sum(c) AS c FROM xy GROUP BY 1), ny AS (SELECT y, sum(c) AS c FROM xy GROUP BY 1), n AS (SELECT sum(c) AS n FROM xy)"""


@query(f"""WITH {BIC} SELECT round((SELECT sum(xy.c * ln(xy.c / nx.c)) FROM xy JOIN nx ON nx.x = xy.x) - (SELECT sum(ny.c * ln(ny.c / n)) FROM ny, n) - 0.5 * ln(n) * ((SELECT count(*) FROM ny) - 1) * ((SELECT count(*) FROM nx) - 1), 4) AS delta FROM n""")
def agg_edge_bic_delta(spark, d):
    """Local BIC of a state with its parent minus without it, from one contingency table."""
    xy = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("y"), F.col("o_orderpriority").alias("x")).agg(F.count("*").alias("c"))
    w = xy.withColumn("nx", F.sum("c").over(Window.partitionBy("x"))).withColumn("ny", F.sum("c").over(Window.partitionBy("y")))
    n = F.broadcast(xy.agg(F.sum("c").alias("n")))  # one row
    g = w.join(n).agg(F.sum(F.col("c") * F.log(F.col("c") / F.col("nx"))).alias("with"), F.sum(F.col("c") * F.log(F.col("ny") / F.col("n"))).alias("without"), F.first("n").alias("n"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"))
    return g.select(F.round(F.col("with") - F.col("without") - 0.5 * F.log("n") * (F.col("ky") - 1) * (F.col("kx") - 1), 4).alias("delta"))


@query("""SELECT CAST(d AS VARCHAR) AS dd, count(*) AS alerts, round(max(abs(ret)), 6) AS top, round(avg(ret), 6) AS market FROM bars WHERE abs(ret) > 0.2 GROUP BY bars.d""")
def agg_state_vector(spark, d):
    g = bars(spark, d).where("abs(ret) > 0.2").groupBy("d").agg(F.count("*").alias("alerts"), F.round(F.max(F.abs("ret")), 6).alias("top"), F.round(F.avg("ret"), 6).alias("market"))
    return g.select(F.col("d").cast("string").alias("dd"), "alerts", "top", "market")


@query("""WITH b AS (SELECT brand, bars.d, ret, lead(ret) OVER (PARTITION BY brand ORDER BY bars.d) AS nxt FROM bars) SELECT brand, CAST(d AS VARCHAR) AS dd, ret AS surprise, nxt FROM b WHERE abs(ret) > 0.4 AND nxt IS NOT NULL""")
def agg_surprise_return_panel(spark, d):
    nxt = F.lead("ret").over(Window.partitionBy("brand").orderBy("d"))
    return bars(spark, d).withColumn("nxt", nxt).where("abs(ret) > 0.4 and nxt is not null").select("brand", F.col("d").cast("string").alias("dd"), F.col("ret").alias("surprise"), "nxt")


@query("""WITH k AS (SELECT entity_a, count(*) AS n FROM links GROUP BY 1), o AS (SELECT entity_id, count(*) AS n FROM obs GROUP BY 1) SELECT count(*) AS customers, count(k.n) AS linked, count(o.n) AS observed, round(count(o.n) / count(*), 6) AS coverage FROM customer LEFT JOIN k ON k.entity_a = 'customer:' || c_custkey LEFT JOIN o ON o.entity_id = 'customer:' || c_custkey""")
def agg_graph_data_gate(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("entity_id"))
    k = links(spark, d).groupBy(F.col("entity_a").alias("entity_id")).agg(F.count("*").alias("k"))
    o = obs(spark, d).groupBy("entity_id").agg(F.count("*").alias("o"))
    return c.join(k, "entity_id", "left").join(o, "entity_id", "left").agg(F.count("*").alias("customers"), F.count("k").alias("linked"), F.count("o").alias("observed"), F.round(F.count("o") / F.count("*"), 6).alias("coverage"))
