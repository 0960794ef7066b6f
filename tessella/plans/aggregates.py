"""Grouped, conditional, distinct, pivoted and approximate aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import latest
from ..registry import query
from .joining import POINTS, points
from .views import bars, country_events, entities, links, obs, positioning, series, table, trades


def r(col, n=6):
    return F.round(col, n)


@query("SELECT entity_id, source, count(*) AS n FROM obs GROUP BY 1, 2")
def agg_count_observations(spark, d):
    return obs(spark, d).groupBy("entity_id", "source").agg(F.count("*").alias("n"))


@query("SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")
def agg_count_entities(spark, d):
    return entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT link_type, count(*) AS n FROM links WHERE confidence >= 0.75 GROUP BY 1")
def agg_count_links(spark, d):
    return links(spark, d).where("confidence >= 0.75").groupBy("link_type").agg(F.count("*").alias("n"))


DENSITY = """den AS (SELECT entity_type, count(DISTINCT o.entity_id) AS entities, count(*) AS n, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days, round(count(*) / count(DISTINCT o.entity_id), 1) AS per_entity
FROM (SELECT entity_id, ts FROM obs UNION ALL SELECT entity_id, ts FROM country_events) o JOIN entities e ON e.entity_id = o.entity_id GROUP BY 1)"""


def density(spark, d):
    o = obs(spark, d).select("entity_id", "ts").union(country_events(spark, d).select("entity_id", "ts"))
    return o.join(entities(spark, d), "entity_id").groupBy("entity_type").agg(
        F.countDistinct("entity_id").alias("entities"), F.count("*").alias("n"), F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).cast("long").alias("days"),
        F.round(F.count("*") / F.countDistinct("entity_id"), 1).alias("per_entity"),
    )


@query(f"WITH {DENSITY} SELECT * FROM den")
def agg_density_by_entity_type(spark, d):
    return density(spark, d)


@query("SELECT source, count(*) AS n FROM obs GROUP BY 1")
def agg_density_by_source(spark, d):
    return obs(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"WITH {DENSITY} SELECT entity_type, rtrim(CASE WHEN n < 20000 THEN 'obs;' ELSE '' END || CASE WHEN days < 60 THEN 'days;' ELSE '' END || CASE WHEN entities < 50 THEN 'entities;' ELSE '' END, ';') AS missed FROM den")
def agg_sparse_flags(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("n") < 20000, F.lit("obs")), F.when(F.col("days") < 60, F.lit("days")), F.when(F.col("entities") < 50, F.lit("entities"))))
    return density(spark, d).select("entity_type", F.array_join(reasons, ";").alias("missed"))


@query("WITH c AS (SELECT entity_id, source, count(*) AS n FROM obs GROUP BY 1, 2), p AS (SELECT entity_id, n / sum(n) OVER (PARTITION BY entity_id) AS p FROM c) SELECT entity_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def agg_shannon_entropy(spark, d):
    c = obs(spark, d).groupBy("entity_id", "source").agg(F.count("*").alias("n"))
    # -sum p ln p = ln N - sum(n ln n) / N: one pass over the counts
    n = F.col("n")
    return c.groupBy("entity_id").agg(r(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy"))


@query("""SELECT CAST(l_shipdate AS DATE)::VARCHAR AS d, p_brand, count(DISTINCT l_linestatus) AS facilities, sum(l_quantity) AS total, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short,
CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) END AS short_ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def agg_facility_rollup(spark, d):
    return shorts(spark, d, [F.to_date("l_shipdate").cast("string").alias("d"), "p_brand"])


def shorts(spark, d, keys):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    short = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    total = F.sum("l_quantity")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(*keys).agg(F.countDistinct("l_linestatus").alias("facilities"), total.alias("total"), short.alias("short"), F.when(total == 0, 0.0).otherwise(r(short / total)).alias("short_ratio"))


@query("""WITH s AS (SELECT p_brand, sum(l_quantity) AS total, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS short_ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT * FROM s WHERE total >= 100 ORDER BY short_ratio DESC, p_brand LIMIT 10""")
def agg_short_scan(spark, d):
    return shorts(spark, d, ["p_brand"]).where("total >= 100").select("p_brand", "total", "short_ratio").orderBy(F.desc("short_ratio"), "p_brand").limit(10)


@query("WITH m AS (SELECT max(ts) AS t FROM country_events) SELECT entity_id, round(avg(score), 6) AS score, round(avg(quad), 6) AS quad, count(*) AS n FROM country_events, m WHERE ts >= t - INTERVAL 90 DAY GROUP BY 1")
def agg_country_goldstein(spark, d):
    e = country_events(spark, d)
    end = F.broadcast(e.agg(F.max("ts").alias("t")))  # one row: the window ends at the data, not at the clock
    return e.join(end, F.col("ts") >= F.expr("t - interval 90 days")).groupBy("entity_id").agg(r(F.avg("score")).alias("score"), r(F.avg("quad")).alias("quad"), F.count("*").alias("n"))


@query("SELECT upper(substr(e.name, 1, 2)) AS iso, round(avg(score), 6) AS score, count(*) AS n FROM country_events c JOIN entities e ON e.entity_id = c.entity_id WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY 1")
def agg_goldstein_by_iso(spark, d):
    e = country_events(spark, d).where("ts >= timestamp '1998-01-01'").join(entities(spark, d), "entity_id")
    return e.groupBy(F.upper(F.substring("name", 1, 2)).alias("iso")).agg(r(F.avg("score")).alias("score"), F.count("*").alias("n"))


SCORES = """ws AS (SELECT wallet, count(*) FILTER (WHERE resolved) AS judged, count(*) FILTER (WHERE resolved AND correct) AS won, sum(usdc) AS volume, count(DISTINCT market) AS markets, max(ts) AS last,
 sum(CASE WHEN resolved AND correct THEN usdc ELSE 0 END) AS win, sum(CASE WHEN resolved AND NOT correct THEN usdc ELSE 0 END) AS loss FROM trades GROUP BY 1),
sc AS (SELECT wallet, round((won + 1) / (judged + 2), 4) AS accuracy, round(win / greatest(abs(loss), 0.01), 4) AS profit_factor, markets,
 round((won + 1) / (judged + 2) * ln(1 + volume) * exp(-ln(2) / 30 * (epoch(TIMESTAMP '2001-12-01') - epoch(last)) / 86400 / 60) * sqrt(markets), 4) AS score FROM ws WHERE judged >= 5)"""


def wallet_scores(spark, d):
    """Per wallet: smoothed accuracy, profit factor, and the composite of accuracy, volume, recency and breadth."""
    t = trades(spark, d)
    judged, won = F.count_if("resolved"), F.count_if(F.col("resolved") & F.col("correct"))
    win = F.sum(F.when(F.col("resolved") & F.col("correct"), F.col("usdc")).otherwise(0.0))
    loss = F.sum(F.when(F.col("resolved") & ~F.col("correct"), F.col("usdc")).otherwise(0.0))
    s = t.groupBy("wallet").agg(judged.alias("judged"), won.alias("won"), F.sum("usdc").alias("volume"), F.countDistinct("market").alias("markets"), F.max("ts").alias("last"), win.alias("win"), loss.alias("loss")).where("judged >= 5")
    accuracy = (F.col("won") + 1) / (F.col("judged") + 2)
    days = (F.unix_timestamp(F.lit("2001-12-01").cast("timestamp")) - F.unix_micros("last") / 1e6) / 86400 / 60
    score = accuracy * F.log1p("volume") * F.exp(-F.log(F.lit(2.0)) / 30 * days) * F.sqrt("markets")
    return s.select("wallet", F.round(accuracy, 4).alias("accuracy"), F.round(F.col("win") / F.greatest(F.abs("loss"), F.lit(0.01)), 4).alias("profit_factor"), "markets", F.round(score, 4).alias("score"))


@query(f"WITH {SCORES} SELECT * FROM sc ORDER BY score DESC, wallet LIMIT 500")
def agg_wallet_scores(spark, d):
    return wallet_scores(spark, d).orderBy(F.desc("score"), "wallet").limit(500)


TOP = f"{SCORES}, tp AS (SELECT * FROM sc ORDER BY score DESC, wallet LIMIT 100)"


def top_wallets(spark, d, n=100):
    return F.broadcast(wallet_scores(spark, d).orderBy(F.desc("score"), "wallet").limit(n).select("wallet", "score"))  # n rows


@query(f"""WITH {TOP} SELECT market, side, round(sum(score * usdc) / greatest(sum(usdc), 0.01), 4) AS confidence, count(DISTINCT t.wallet) AS wallets, round(avg(price), 6) AS price
FROM trades t JOIN tp ON tp.wallet = t.wallet GROUP BY 1, 2 HAVING count(DISTINCT t.wallet) >= 3""")
def agg_consensus(spark, d):
    j = trades(spark, d).join(top_wallets(spark, d), "wallet")
    return j.groupBy("market", "side").agg(
        F.round(F.sum(F.col("score") * F.col("usdc")) / F.greatest(F.sum("usdc"), F.lit(0.01)), 4).alias("confidence"), F.countDistinct("wallet").alias("wallets"), r(F.avg("price")).alias("price")
    ).where("wallets >= 3")


@query(f"WITH {TOP} SELECT t.wallet, market, side, usdc, epoch_us(ts) AS us FROM trades t WHERE usdc >= 60000 AND t.wallet IN (SELECT wallet FROM tp)")
def agg_whale_alerts(spark, d):
    return trades(spark, d).where("usdc >= 60000").join(top_wallets(spark, d), "wallet", "left_semi").select("wallet", "market", "side", "usdc", F.unix_micros("ts").alias("us"))


@query(f"WITH {TOP} SELECT t.wallet, market, side, price, usdc FROM trades t WHERE ((side = 'buy' AND price < 0.3) OR (side = 'sell' AND price > 0.7)) AND t.wallet IN (SELECT wallet FROM tp)")
def agg_contrarian(spark, d):
    against = ((F.col("side") == "buy") & (F.col("price") < 0.3)) | ((F.col("side") == "sell") & (F.col("price") > 0.7))
    return trades(spark, d).where(against).join(top_wallets(spark, d), "wallet", "left_semi").select("wallet", "market", "side", "price", "usdc")


@query(f"WITH {POINTS} SELECT floor(lat / 2)::BIGINT AS cy, floor(lon / 2)::BIGINT AS cx, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(value), 6) AS mean_frp, round(max(value), 6) AS max_frp, round(sum(value), 6) AS total_frp FROM pt GROUP BY 1, 2")
def agg_hotspot_clusters(spark, d):
    cell = lambda c: F.floor(F.col(c) / 2)
    return points(spark, d).groupBy(cell("lat").alias("cy"), cell("lon").alias("cx")).agg(
        F.count("*").alias("n"), r(F.avg("lat")).alias("lat"), r(F.avg("lon")).alias("lon"), r(F.avg("value")).alias("mean_frp"), r(F.max("value")).alias("max_frp"), r(F.sum("value")).alias("total_frp")
    )


@query("SELECT source AS zone, round(sum(value), 6) AS frp, count(*) AS n, round(avg(value) FILTER (WHERE value > 0), 6) AS brightness, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS strong FROM obs GROUP BY 1")
def agg_zone_radiative_power(spark, d):
    return obs(spark, d).groupBy(F.col("source").alias("zone")).agg(r(F.sum("value")).alias("frp"), F.count("*").alias("n"), r(F.avg(F.when(F.col("value") > 0, F.col("value")))).alias("brightness"), r(F.count_if(F.col("value") > 50) / F.count("*")).alias("strong"))


@query("SELECT o_custkey, count(*) AS n, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last FROM orders GROUP BY 1 HAVING count(*) >= 2")
def agg_filing_clusters(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.to_date(F.min("o_orderdate")).cast("string").alias("first"), F.to_date(F.max("o_orderdate")).cast("string").alias("last")).where("n >= 2")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS red FROM orders GROUP BY 1")
def agg_red_flag_charges(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("red"))


@query("""SELECT o_custkey, round(sum(o_totalprice), 4) AS total, count(*) AS n, arg_max(o_orderkey, o_totalprice) AS largest FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 0 AND date_trunc('month', o_orderdate) = DATE '1996-05-01'
GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 8""")
def agg_issuer_week_ranking(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 0 and trunc(o_orderdate, 'month') = date '1996-05-01'")
    return o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("total"), F.count("*").alias("n"), F.max_by("o_orderkey", "o_totalprice").alias("largest")).orderBy(F.desc("total"), "o_custkey").limit(8)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS item FROM orders WHERE date_trunc('week', o_orderdate) = DATE '1997-03-03'")
def agg_credit_stress_week(spark, d):
    labels = F.create_map(F.lit("F"), F.lit("filled"), F.lit("O"), F.lit("open"))
    o = table(spark, d, "orders").where("date_trunc('week', o_orderdate) = timestamp '1997-03-03'")
    return o.select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.lit("other")).alias("item"))


@query("""WITH q AS (SELECT p_brand, p_size AS strike, p_retailprice / 1000 AS iv, p_partkey, p_partkey % 2 = 0 AS call, p_size * 3 AS oi FROM part), s AS (SELECT p_brand, quantile_cont(strike, 0.5) AS spot FROM q GROUP BY 1)
SELECT q.p_brand, round(arg_min(iv, {'a': abs(strike - spot), 'b': p_partkey}), 6) AS atm_iv, round(sum(CASE WHEN NOT call THEN oi ELSE 0 END) / sum(CASE WHEN call THEN oi ELSE 0 END), 6) AS put_call, sum(oi)::BIGINT AS oi FROM q JOIN s ON s.p_brand = q.p_brand GROUP BY 1""")
def agg_chain_summary(spark, d):
    q = table(spark, d, "part").select("p_brand", F.col("p_size").alias("strike"), (F.col("p_retailprice") / 1000).alias("iv"), "p_partkey", (F.col("p_partkey") % 2 == 0).alias("call"), (F.col("p_size") * 3).alias("oi"))
    s = q.groupBy("p_brand").agg(F.percentile("strike", 0.5).alias("spot"))
    side = lambda c: F.sum(F.when(c, F.col("oi")).otherwise(0))
    return q.join(s, "p_brand").groupBy("p_brand").agg(
        r(F.min_by("iv", F.struct(F.abs(F.col("strike") - F.col("spot")), "p_partkey"))).alias("atm_iv"), r(side(~F.col("call")) / side(F.col("call"))).alias("put_call"), F.sum("oi").alias("oi")
    )


@query("SELECT upper(p_type) AS destination, count(*) AS vessels, round(count(*) / sum(count(*)) OVER (), 6) AS share, CASE WHEN upper(p_type) LIKE '%STEEL%' OR upper(p_type) LIKE '%BRASS%' THEN 'strategic' ELSE 'other' END AS grp FROM part GROUP BY 1, p_type")
def agg_destination_flow(spark, d):
    c = table(spark, d, "part").groupBy(F.upper("p_type").alias("destination")).agg(F.count("*").alias("vessels"))
    total = F.broadcast(c.agg(F.sum("vessels").alias("t")))  # one row
    return c.join(total).select("destination", "vessels", r(F.col("vessels") / F.col("t")).alias("share"), F.when(F.col("destination").rlike("STEEL|BRASS"), "strategic").otherwise("other").alias("grp"))


@query(f"WITH {POINTS} SELECT event_id % 10 AS kind, count(*) AS n FROM pt WHERE lat BETWEEN 40 AND 60 AND lon BETWEEN -10 AND 30 GROUP BY 1")
def agg_area_vessel_count(spark, d):
    p = points(spark, d).where("lat between 40 and 60 and lon between -10 and 30")
    return p.groupBy((F.col("event_id") % 10).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS agencies, count(DISTINCT o_orderstatus) AS jurisdictions, count(DISTINCT o_orderpriority) >= 3 OR count(DISTINCT o_orderstatus) >= 2 AS converges FROM orders GROUP BY 1")
def agg_agency_convergence(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("agencies"), F.countDistinct("o_orderstatus").alias("jurisdictions"))
    return a.withColumn("converges", (F.col("agencies") >= 3) | (F.col("jurisdictions") >= 2))


MONTHLY = "mo AS (SELECT l_returnflag AS border, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def monthly(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("border"), F.to_date(F.trunc("l_shipdate", "month")).alias("m")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {MONTHLY} SELECT border, CAST(m AS VARCHAR) AS m, v, round((v / lag(v) OVER (PARTITION BY border ORDER BY mo.m) - 1) * 100, 4) AS pct FROM mo")
def agg_border_trend(spark, d):
    w = Window.partitionBy("border").orderBy("m")
    x = monthly(spark, d).withColumn("pct", F.round((F.col("v") / F.lag("v").over(w) - 1) * 100, 4))
    return x.withColumn("m", F.col("m").cast("string"))


@query(f"WITH {MONTHLY} SELECT CAST(m AS VARCHAR) AS m, sum(v) FILTER (WHERE border = 'A') AS a, sum(v) FILTER (WHERE border = 'N') AS n, sum(v) FILTER (WHERE border = 'R') AS r FROM mo GROUP BY 1")
def agg_border_compare(spark, d):
    wide = monthly(spark, d).groupBy("m").pivot("border", ["A", "N", "R"]).agg(F.sum("v"))
    return wide.select(F.col("m").cast("string").alias("m"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT side, count(*) AS n, round(sum(usdc), 2) AS total, max(usdc) AS largest, round(avg(usdc), 4) AS mean FROM trades WHERE usdc >= 40000 GROUP BY 1")
def agg_transfer_summary(spark, d):
    return trades(spark, d).where("usdc >= 40000").groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("usdc"), 2).alias("total"), F.max("usdc").alias("largest"), F.round(F.avg("usdc"), 4).alias("mean"))


@query("""SELECT grouping(p_brand)::BIGINT AS g, p_brand, p_type, count(*) AS n, sum(p_size)::BIGINT AS capacity FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
def agg_queue_summary(spark, d):
    p = table(spark, d, "part")
    g = p.groupingSets([[p.p_brand], [p.p_type], []], p.p_brand, p.p_type)
    return g.agg(F.grouping("p_brand").cast("long").alias("g"), F.count("*").alias("n"), F.sum("p_size").alias("capacity")).select("g", "p_brand", "p_type", "n", "capacity")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, round(max(v), 6) AS peak, round(min(v), 6) AS trough, round(avg(v), 6) AS mean, count(*) AS hours FROM (SELECT date_trunc('hour', ts) AS ts, sum(value) AS v FROM obs GROUP BY 1) WHERE v > 0 GROUP BY 1")
def agg_hourly_demand(spark, d):
    h = obs(spark, d).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v")).where("v > 0")
    return h.groupBy(F.to_date("h").cast("string").alias("d")).agg(r(F.max("v")).alias("peak"), r(F.min("v")).alias("trough"), r(F.avg("v")).alias("mean"), F.count("*").alias("hours"))


@query("SELECT source AS fuel, round(sum(value), 6) AS v, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM obs WHERE value > 0 GROUP BY 1")
def agg_fuel_mix(spark, d):
    f = obs(spark, d).where("value > 0").groupBy(F.col("source").alias("fuel")).agg(F.sum("value").alias("s"))
    total = F.broadcast(f.agg(F.sum("s").alias("t")))  # one row
    return f.join(total).select("fuel", r("s").alias("v"), r(F.col("s") / F.col("t")).alias("share"))


@query("SELECT c_mktsegment AS reporter, c_nationkey AS partner, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 0 GROUP BY 1, 2")
def agg_partner_ranking(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey <> 0")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("reporter"), F.col("c_nationkey").alias("partner")).agg(F.round(F.sum("o_totalprice"), 2).alias("v")).orderBy("reporter", F.desc("v"))


LATEST = "la AS (SELECT signal, value, d FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY series.d DESC) AS k FROM series) WHERE k = 1)"


def latest_signals(spark, d):
    return latest(series(spark, d), ["signal"], "d", ties=False)


@query(f"WITH {LATEST} SELECT round(sum(CASE WHEN signal LIKE 'orders.%' THEN value WHEN signal LIKE 'flag.%' THEN -0.5 * value WHEN signal LIKE 'priority.%' THEN -value ELSE 0 END), 6) AS index FROM la")
def agg_liquidity_index(spark, d):
    weight = F.when(F.col("signal").startswith("orders."), 1.0).when(F.col("signal").startswith("flag."), -0.5).when(F.col("signal").startswith("priority."), -1.0).otherwise(0.0)
    return latest_signals(spark, d).agg(r(F.sum(weight * F.col("value"))).alias("index"))


@query(f"WITH {LATEST} SELECT a.signal, round(a.value - b.value, 6) AS spread FROM la a, la b WHERE b.signal = 'ship.nation:7' AND a.signal LIKE 'ship.%'")
def agg_spread_vs_base(spark, d):
    la = latest_signals(spark, d)
    base = F.broadcast(la.where("signal = 'ship.nation:7'").select(F.col("value").alias("base")))  # one row
    return la.where("signal like 'ship.%'").join(base).select("signal", r(F.col("value") - F.col("base")).alias("spread"))


@query(f"WITH {LATEST} SELECT 'R-A' AS pair, round(a.value - b.value, 6) AS spread FROM la a, la b WHERE a.signal = 'flag.R' AND b.signal = 'flag.A' UNION ALL SELECT 'U-L', round(a.value - b.value, 6) FROM la a, la b WHERE a.signal = 'priority.1-URGENT' AND b.signal = 'priority.5-LOW'")
def agg_pair_spreads(spark, d):
    pairs = spark.createDataFrame([("R-A", "flag.R", "flag.A"), ("U-L", "priority.1-URGENT", "priority.5-LOW")], "pair string, s1 string, s2 string")
    la = latest_signals(spark, d).select("signal", "value")
    one = la.select(F.col("signal").alias("s1"), F.col("value").alias("v1"))
    two = la.select(F.col("signal").alias("s2"), F.col("value").alias("v2"))
    return one.join(F.broadcast(pairs), "s1").join(two, "s2").select("pair", r(F.col("v1") - F.col("v2")).alias("spread"))


@query("""SELECT CAST(d AS VARCHAR) AS d, count(*) FILTER (WHERE ret <= -0.2) AS sellers, count(*) FILTER (WHERE ret >= 0.2) AS buyers, coalesce(string_agg(brand, ',' ORDER BY brand) FILTER (WHERE ret <= -0.2), '') AS who FROM bars GROUP BY bars.d HAVING count(*) FILTER (WHERE ret <= -0.2) >= 2 OR count(*) FILTER (WHERE ret >= 0.2) >= 2""")
def agg_coordinated_moves(spark, d):
    sell, buy = F.col("ret") <= -0.2, F.col("ret") >= 0.2
    g = bars(spark, d).groupBy("d").agg(F.count_if(sell).alias("sellers"), F.count_if(buy).alias("buyers"), F.array_join(F.array_sort(F.collect_list(F.when(sell, F.col("brand")))), ",").alias("who"))
    return g.where("sellers >= 2 or buyers >= 2").withColumn("d", F.col("d").cast("string"))


@query("""WITH m AS (SELECT brand, arg_max(ret, d) AS x FROM bars WHERE ret IS NOT NULL GROUP BY 1) SELECT round(least(100, greatest(0, 50 + 50 * (count(*) FILTER (WHERE x > 0) / count(*) - 0.5) + 20 * avg(CASE WHEN x > 0 THEN x ELSE 0.5 * x END))), 4) AS pressure FROM m""")
def agg_pressure_index(spark, d):
    m = bars(spark, d).where("ret is not null").groupBy("brand").agg(F.max_by("ret", "d").alias("x"))
    breadth = F.count_if(F.col("x") > 0) / F.count("*") - 0.5
    size = F.avg(F.when(F.col("x") > 0, F.col("x")).otherwise(0.5 * F.col("x")))
    return m.agg(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 50 * breadth + 20 * size)), 4).alias("pressure"))


SLAS = [("click", 12), ("view", 1), ("error", 2), ("purchase", 48), ("signup", 24), ("unknown_source", 6)]


@query("""WITH sla(source, hours) AS (VALUES ('click', 12), ('view', 1), ('error', 2), ('purchase', 48), ('signup', 24), ('unknown_source', 6)), l AS (SELECT source, max(ts) AS t FROM obs GROUP BY 1)
SELECT sla.source, round((epoch(TIMESTAMP '2024-01-31') - epoch(t)) / 3600, 4) AS age, coalesce((epoch(TIMESTAMP '2024-01-31') - epoch(t)) / 3600 > hours, true) AS breach, t IS NULL AS never FROM sla LEFT JOIN l ON l.source = sla.source""")
def agg_freshness(spark, d):
    sla = spark.createDataFrame(SLAS, "source string, hours int")
    last = obs(spark, d).groupBy("source").agg(F.max("ts").alias("t"))
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("t")) / 3.6e9
    return sla.join(last, "source", "left").select("source", F.round(age, 4).alias("age"), F.coalesce(age > F.col("hours"), F.lit(True)).alias("breach"), F.col("t").isNull().alias("never"))


@query("SELECT entity_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM obs GROUP BY 1")
def agg_lineage(spark, d):
    return obs(spark, d).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT 'entity' AS kind, entity_type AS name, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'link', link_type, count(*) FROM links GROUP BY 2 UNION ALL SELECT 'observation', source, count(*) FROM obs GROUP BY 2")
def agg_graph_census(spark, d):
    count = lambda df, kind, col: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(entities(spark, d), "entity", "entity_type").union(count(links(spark, d), "link", "link_type")).union(count(obs(spark, d), "observation", "source"))


@query("""WITH nf(niche, source) AS (VALUES ('web', 'click'), ('web', 'view'), ('web', 'absent'), ('sales', 'purchase'), ('sales', 'signup')) SELECT niche, count(DISTINCT entity_id) AS entities, count(obs_id) AS n, count(DISTINCT obs.source) AS hit,
coalesce(string_agg(DISTINCT nf.source, ',' ORDER BY nf.source) FILTER (WHERE obs_id IS NULL), '') AS missing FROM nf LEFT JOIN obs ON obs.source = nf.source GROUP BY 1""")
def agg_niche_stats(spark, d):
    niches = spark.createDataFrame([("web", "click"), ("web", "view"), ("web", "absent"), ("sales", "purchase"), ("sales", "signup")], "niche string, want string")
    o = obs(spark, d)
    j = niches.join(o, niches.want == o.source, "left")
    return j.groupBy("niche").agg(F.countDistinct("entity_id").alias("entities"), F.count("obs_id").alias("n"), F.countDistinct("source").alias("hit"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("obs_id").isNull(), F.col("want")))), ",").alias("missing"))


@query("SELECT entity_id, source, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ROLLUP (entity_id, source) HAVING entity_id IS NOT NULL")
def agg_usage_by_endpoint(spark, d):
    return obs(spark, d).where("ts >= timestamp '2024-01-10'").rollup("entity_id", "source").agg(F.count("*").alias("n")).where("entity_id is not null")


@query("SELECT entity_id, count(*) AS n, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) AS age_us, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean FROM obs GROUP BY 1")
def agg_obs_stats(spark, d):
    from ..functions.scalars import json_number

    return obs(spark, d).groupBy("entity_id").agg(F.count("*").alias("n"), (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.max("ts"))).alias("age_us"), r(F.avg(json_number(F.col("props"), "k"))).alias("mean"))


@query("""WITH s AS (SELECT entity_id, list(value ORDER BY value) AS v, var_samp(value) AS var, count(DISTINCT source) AS sources FROM obs GROUP BY 1)
SELECT entity_id, round(var, 5) AS var, v[1] AS lo, v[len(v)] AS hi, round(v[(3 * len(v)) // 4 + 1] - v[len(v) // 4 + 1], 6) AS iqr, sources FROM s""")
def agg_distribution_features(spark, d):
    """Quartiles by the floor-index rule: sorted[n/4] and sorted[3n/4]. Ranks come from running counts of distinct values, so equal values are one row and no entity's values are gathered."""
    o = obs(spark, d)
    s = o.groupBy("entity_id").agg(F.count("*").alias("n"), F.var_samp("value").alias("var"), F.countDistinct("source").alias("sources"))
    c = o.groupBy("entity_id", "value").agg(F.count("*").alias("c"))
    c = c.withColumn("upto", F.sum("c").over(Window.partitionBy("entity_id").orderBy("value")))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("value")))
    q = c.join(s, "entity_id").groupBy("entity_id").agg(F.first("var").alias("var"), F.min("value").alias("lo"), F.max("value").alias("hi"), at(F.expr("3 * n div 4")).alias("q3"), at(F.expr("n div 4")).alias("q1"), F.first("sources").alias("sources"))
    return q.select("entity_id", F.round("var", 5).alias("var"), "lo", "hi", r(F.col("q3") - F.col("q1")).alias("iqr"), "sources")


POSTERIOR = "be AS (SELECT o_orderpriority AS agency, CASE WHEN o_totalprice < 100000 THEN 's' WHEN o_totalprice < 250000 THEN 'm' ELSE 'l' END AS bucket, (2 + count(*) FILTER (WHERE o_orderstatus = 'F')) / (5 + count(*)) AS p FROM orders GROUP BY 1, 2)"


def posterior(spark, d):
    bucket = F.when(F.col("o_totalprice") < 100000, "s").when(F.col("o_totalprice") < 250000, "m").otherwise("l")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("agency"), bucket.alias("bucket")).agg(((2 + F.count_if(F.col("o_orderstatus") == "F")) / (5 + F.count("*"))).alias("p"))


@query(f"WITH {POSTERIOR} SELECT agency, bucket, round(p, 6) AS p FROM be")
def agg_beta_posterior(spark, d):
    return posterior(spark, d).withColumn("p", r("p"))


@query(f"WITH {POSTERIOR} SELECT o_orderkey, round(least(greatest(p, 0), 1) * (o_totalprice - least(o_totalprice, 10000)) - 500, 4) AS ev FROM orders JOIN be ON agency = o_orderpriority AND bucket = CASE WHEN o_totalprice < 100000 THEN 's' WHEN o_totalprice < 250000 THEN 'm' ELSE 'l' END")
def agg_opportunity_ev(spark, d):
    bucket = F.when(F.col("o_totalprice") < 100000, "s").when(F.col("o_totalprice") < 250000, "m").otherwise("l")
    o = table(spark, d, "orders").withColumn("bucket", bucket).withColumn("agency", F.col("o_orderpriority"))
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    return o.join(posterior(spark, d), ["agency", "bucket"]).select("o_orderkey", F.round(p * (F.col("o_totalprice") - F.least("o_totalprice", F.lit(10000.0))) - 500, 4).alias("ev"))


@query("""WITH a AS (SELECT source, count(*) / sum(count(*)) OVER () AS p FROM obs WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT source, count(*) / sum(count(*)) OVER () AS q FROM obs WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT round(sum(p * ln(p / q)), 8) AS kl FROM a JOIN b ON a.source = b.source""")
def agg_kl_divergence(spark, d):
    """From two columns of counts: sum p ln(p/q)."""
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    c = obs(spark, d).groupBy("source").agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    t = F.broadcast(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    return c.join(t).where("a > 0 and b > 0").agg(F.round(F.sum(p * F.log(p / q)), 8).alias("kl"))


@query("""WITH s AS (SELECT o_orderpriority AS pr, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT DISTINCT o_orderpriority AS pr FROM orders), c AS (SELECT DISTINCT o_orderstatus AS st FROM orders)
SELECT p.pr AS parent, c.st AS child, round((coalesce(s.n, 0) + 10.0 / (SELECT count(*) FROM p) / (SELECT count(*) FROM c)) / (sum(coalesce(s.n, 0)) OVER (PARTITION BY p.pr) + 10.0 / (SELECT count(*) FROM p)), 8) AS prob FROM p CROSS JOIN c LEFT JOIN s ON s.pr = p.pr AND s.st = c.st""")
def agg_cpd_table(spark, d):
    """BDeu estimate over the whole grid of states (few by definition)."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("child"))
    n = o.groupBy("parent", "child").agg(F.count("*").alias("n"))
    ps, cs = o.select("parent").distinct(), o.select("child").distinct()
    grid = ps.join(F.broadcast(cs)).join(n, ["parent", "child"], "left").fillna(0, ["n"])  # states of one variable
    sizes = F.broadcast(ps.agg(F.count("*").alias("np")).join(cs.agg(F.count("*").alias("nc"))))
    a = 10.0 / F.col("np")
    return grid.join(sizes).select("parent", "child", F.round((F.col("n") + a / F.col("nc")) / (F.sum("n").over(Window.partitionBy("parent")) + a), 8).alias("prob"))


@query("""WITH w AS (SELECT *, CAST(d AS DATE) AS dd FROM series WHERE series.d BETWEEN DATE '1998-01-01' AND DATE '1998-01-07'), x AS (SELECT category, count(DISTINCT signal) AS breadth, max(value) AS intensity, count(DISTINCT dd) AS persistence FROM w GROUP BY 1) SELECT * FROM x""")
def agg_convergence_features(spark, d):
    w = series(spark, d).where(F.col("d").between("1998-01-01", "1998-01-07"))
    return w.groupBy("category").agg(F.countDistinct("signal").alias("breadth"), F.max("value").alias("intensity"), F.countDistinct("d").alias("persistence"))


@query("""SELECT CAST(d AS VARCHAR) AS d, max(value) FILTER (WHERE signal = 'flag.A') AS flag_a, max(value) FILTER (WHERE signal = 'flag.N') AS flag_n, max(value) FILTER (WHERE signal = 'flag.R') AS flag_r FROM series WHERE category = 'returns' GROUP BY series.d""")
def agg_feature_snapshots(spark, d):
    wide = series(spark, d).where("category = 'returns'").groupBy("d").pivot("signal", ["flag.A", "flag.N", "flag.R"]).agg(F.max("value"))
    return wide.select(F.col("d").cast("string").alias("d"), *[F.col(f"`flag.{x}`").alias(f"flag_{x.lower()}") for x in "ANR"])


@query("""WITH c AS (SELECT CAST(DATE '1998-01-01' + CAST(i AS INTEGER) AS DATE) AS d FROM range(90) t(i)), g AS (SELECT d, arg_max(signal, {'v': value, 's': signal}) AS label FROM series WHERE category = 'urgency' GROUP BY 1) SELECT CAST(c.d AS VARCHAR) AS d, coalesce(label, 'unknown') AS label FROM c LEFT JOIN g ON g.d = c.d""")
def agg_regime_labels(spark, d):
    days = spark.range(90).select(F.expr("date_add(date '1998-01-01', cast(id as int))").alias("d"))
    g = series(spark, d).where("category = 'urgency'").groupBy("d").agg(F.max_by("signal", F.struct("value", "signal")).alias("label"))
    return days.join(g, "d", "left").select(F.col("d").cast("string").alias("d"), F.coalesce("label", F.lit("unknown")).alias("label"))


@query("""WITH e AS (SELECT brand, week, longs / oi AS conf FROM positioning), f AS (SELECT *, CASE WHEN conf >= 0.7 THEN 1 WHEN conf <= 0.3 THEN -1 ELSE 0 END AS s FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY f.week) - row_number() OVER (PARTITION BY brand, s ORDER BY f.week) AS isl FROM f),
h AS (SELECT brand, CAST(week AS VARCHAR) AS week, s * row_number() OVER (PARTITION BY brand, s, isl ORDER BY g.week) AS streak FROM g) SELECT * FROM h WHERE abs(streak) >= 2""")
def agg_edge_hysteresis(spark, d):
    conf = F.col("longs") / F.col("oi")
    f = positioning(spark, d).withColumn("s", F.when(conf >= 0.7, 1).when(conf <= 0.3, -1).otherwise(0))
    w = Window.partitionBy("brand").orderBy("week")
    isl = F.row_number().over(w) - F.row_number().over(Window.partitionBy("brand", "s").orderBy("week"))
    g = f.withColumn("isl", isl).withColumn("streak", F.col("s") * F.row_number().over(Window.partitionBy("brand", "s", "isl").orderBy("week")))
    return g.where("abs(streak) >= 2").select("brand", F.col("week").cast("string").alias("week"), F.col("streak").cast("long").alias("streak"))


@query("""WITH b AS (SELECT brand, count(*) AS bars, max(d) - min(d) AS span FROM bars GROUP BY 1), p AS (SELECT brand, count(*) AS weeks FROM positioning GROUP BY 1), k AS (SELECT entity_a, count(*) AS links FROM links GROUP BY 1)
SELECT b.brand, bars, span::BIGINT AS span, weeks, coalesce(links, 0) AS links, bars >= 1400 AND weeks >= 200 AND coalesce(links, 0) >= 3 AS pass FROM b LEFT JOIN p ON p.brand = b.brand LEFT JOIN k ON k.entity_a = 'brand:' || b.brand""")
def agg_commodity_data_gate(spark, d):
    b = bars(spark, d).groupBy("brand").agg(F.count("*").alias("bars"), F.date_diff(F.max("d"), F.min("d")).cast("long").alias("span"))
    p = positioning(spark, d).groupBy("brand").agg(F.count("*").alias("weeks"))
    k = links(spark, d).groupBy(F.expr("substring(entity_a, 7)").alias("brand"), F.col("entity_a").startswith("brand:").alias("ok")).agg(F.count("*").alias("links")).where("ok").drop("ok")
    out = b.join(p, "brand", "left").join(k, "brand", "left").fillna(0, ["links"])
    return out.withColumn("pass", (F.col("bars") >= 1400) & (F.col("weeks") >= 200) & (F.col("links") >= 3))


@query("SELECT source, count(*) AS n, epoch_us(max(ts)) AS last_us, count(DISTINCT entity_id) AS sensors FROM obs GROUP BY 1")
def agg_sensor_health(spark, d):
    return obs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.unix_micros(F.max("ts")).alias("last_us"), F.countDistinct("entity_id").alias("sensors"))


@query("SELECT source, sha256('[' || string_agg(DISTINCT '\"' || k || '\"', ',' ORDER BY '\"' || k || '\"') || ']') AS fingerprint FROM (SELECT source, unnest(json_keys(props)) AS k FROM obs) GROUP BY 1")
def agg_schema_fingerprint(spark, d):
    keys = obs(spark, d).select("source", F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("source").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("k"))), 256).alias("fingerprint"))


@query()
def agg_approx_distinct(spark, d):
    return obs(spark, d).groupBy("source").agg(F.approx_count_distinct("entity_id", 0.02).alias("approx_entities"))
