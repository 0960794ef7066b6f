"""Per-source modes: filters, rankings, rollups and signal ladders over landed rows.

The modes share four shapes. Each shape is one function of a DataFrame; a mode is a call of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from .joining import POINTS, points, zones
from .views import bars, country_events, entities, obs, positioning, series, table, trades


def search(df: DataFrame, columns: list[str], text: str | None = None, where: Column | None = None, order: list = (), limit: int | None = None) -> DataFrame:
    """Rows whose columns hold the text (any case) and meet the condition, in order, up to the limit."""
    if text is not None:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
        df = df.where(hit)
    if where is not None:
        df = df.where(where)
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit is not None else df


def ranked(df: DataFrame, by: list, measures: dict[str, Column], order: list, limit: int | None = None) -> DataFrame:
    """Sums and counts per group, ranked."""
    out = df.groupBy(*by).agg(*[v.alias(k) for k, v in measures.items()]).orderBy(*order)
    return out.limit(limit) if limit is not None else out


def trend_signals(df: DataFrame, keys: list[str], order: str, value: str, short: int = 1, long: int = 12, band: float = 2.0) -> DataFrame:
    """At the last row of each key: latest, change on `short` and `long` rows back in percent, mean, trend and run of declines."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_n", F.row_number().over(w)).withColumn("_short", F.lag(value, short).over(w)).withColumn("_long", F.lag(value, long).over(w)).withColumn("_down", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))
    g = x.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value).alias("latest"), "_short", "_long", F.col(order).alias("at")), "_n").alias("l"), F.avg(value).alias("mean"),
        (F.max("_n") - F.coalesce(F.max(F.when(~F.col("_down"), F.col("_n"))), F.lit(0))).cast("long").alias("declines"), F.count("*").alias("points"),
    )
    pct = lambda b: F.round((F.col("l.latest") / F.col(b) - 1) * 100, 2)
    out = g.select(*keys, F.col("l.latest").alias("latest"), pct("l._short").alias("change_short"), pct("l._long").alias("change_long"), F.round("mean", 4).alias("mean"), "declines", "points")
    return out.withColumn("trend", F.when(F.col("change_short") > band, "rising").when(F.col("change_short") < -band, "falling").otherwise("stable"))


def trend_sql(source: str, key: str, order: str, value: str, short: int = 1, long: int = 12, band: float = 2.0) -> str:
    return f"""x AS (SELECT {key}, {value} AS v, row_number() OVER w AS n, lag({value}, {short}) OVER w AS s, lag({value}, {long}) OVER w AS l, coalesce({value} < lag({value}) OVER w, false) AS down FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {source}.{order})),
g AS (SELECT {key}, arg_max(v, n) AS latest, max(v) FILTER (WHERE n = m) AS unused, arg_max(CASE WHEN s IS NULL THEN NULL ELSE v / s END, n) AS rs, arg_max(CASE WHEN l IS NULL THEN NULL ELSE v / l END, n) AS rl, avg(v) AS mean, max(n) - coalesce(max(n) FILTER (WHERE NOT down), 0) AS declines, count(*) AS points FROM (SELECT *, max(n) OVER (PARTITION BY {key}) AS m FROM x) GROUP BY 1),
t AS (SELECT {key}, latest, round((rs - 1) * 100, 2) AS change_short, round((rl - 1) * 100, 2) AS change_long, round(mean, 4) AS mean, declines, points FROM g)
SELECT *, CASE WHEN change_short > {band} THEN 'rising' WHEN change_short < -{band} THEN 'falling' ELSE 'stable' END AS trend FROM t"""


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows at which the value differs from the one before, with the step."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(value) != F.col("before"))).withColumn("step", F.col(value) - F.col("before"))


MONTHS = "mm AS (SELECT signal, CAST(date_trunc('month', d) AS DATE) AS m, sum(value) AS v FROM series GROUP BY 1, 2)"


def monthly(spark, d, category: str | None = None):
    s = series(spark, d)
    s = s.where(F.col("category") == category) if category else s
    return s.groupBy("signal", F.to_date(F.trunc("d", "month")).alias("m")).agg(F.sum("value").alias("v"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name || ' '), 'ring') AND p_size >= 40 ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def mod_search(spark, d):
    """Search modes: text match, arguments, newest or largest first."""
    return search(table(spark, d, "part"), ["p_name"], "RING", F.col("p_size") >= 40, [F.desc("p_retailprice"), "p_partkey"], 50).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT source, obs_id, value FROM obs WHERE ts >= TIMESTAMP '2024-01-25' ORDER BY ts DESC, obs_id LIMIT 100")
def mod_recent(spark, d):
    return search(obs(spark, d), [], where=F.col("ts") >= F.lit("2024-01-25").cast("timestamp"), order=[F.desc("ts"), "obs_id"], limit=100).select("source", "obs_id", "value")


@query("SELECT market, side, count(*) AS n, round(sum(usdc), 2) AS volume FROM trades GROUP BY 1, 2 ORDER BY volume DESC, market, side LIMIT 40")
def mod_market_ranking(spark, d):
    t = trades(spark, d)
    return ranked(t, ["market", "side"], {"n": F.count("*"), "volume": F.round(F.sum("usdc"), 2)}, [F.desc("volume"), "market", "side"], 40)


@query("SELECT o_orderpriority AS program, count(*) AS n, count(DISTINCT o_custkey) AS entities, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest FROM orders GROUP BY 1")
def mod_programs_overview(spark, d):
    o = table(spark, d, "orders")
    return ranked(o, [F.col("o_orderpriority").alias("program")], {"n": F.count("*"), "entities": F.countDistinct("o_custkey"), "latest": F.to_date(F.max("o_orderdate")).cast("string")}, [F.desc("n")])


@query(f"WITH {MONTHS}, {trend_sql('mm', 'signal', 'm', 'v')}")
def mod_series_signals(spark, d):
    """Signal ladders of the statistics sources: latest, month and year change, mean, run of declines."""
    return trend_signals(monthly(spark, d), ["signal"], "m", "v")


@query(f"WITH pw AS (SELECT brand, week AS m, oi AS v FROM positioning), {trend_sql('pw', 'brand', 'm', 'v', 1, 52, 5.0)}")
def mod_weekly_stock_signals(spark, d):
    return trend_signals(positioning(spark, d), ["brand"], "week", "oi", 1, 52, 5.0)


@query("""WITH x AS (SELECT brand, positioning.week, longs > shorts AS long, lag(longs > shorts) OVER (PARTITION BY brand ORDER BY positioning.week) AS p FROM positioning) SELECT brand, CAST(week AS VARCHAR) AS wk, CAST(long AS INTEGER) - CAST(p AS INTEGER) AS step FROM x WHERE long <> p""")
def mod_detect_rate_change(spark, d):
    p = positioning(spark, d).withColumn("long", (F.col("longs") > F.col("shorts")).cast("int"))
    return changes(p, ["brand"], "week", "long").select("brand", F.col("week").cast("string").alias("wk"), "step")


@query("SELECT entity_id, quad, count(*) AS n, round(avg(score), 6) AS score, count(*) FILTER (WHERE score <= -8) AS severe FROM country_events GROUP BY 1, 2")
def mod_outage_signals(spark, d):
    e = country_events(spark, d)
    return ranked(e, ["entity_id", "quad"], {"n": F.count("*"), "score": F.round(F.avg("score"), 6), "severe": F.count_if(F.col("score") <= -8)}, ["entity_id", "quad"])


@query("""WITH c AS (SELECT source, CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE value > 90) AS bad FROM obs GROUP BY 1, 2) SELECT source, CAST(d AS VARCHAR) AS dd, round(100.0 * bad / n, 4) AS rate, CASE WHEN 100.0 * bad / n >= 20 THEN 'high' WHEN 100.0 * bad / n >= 10 THEN 'elevated' ELSE 'normal' END AS alert FROM c""")
def mod_censorship_signals(spark, d):
    c = obs(spark, d).groupBy("source", F.to_date("ts").cast("string").alias("dd")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("bad"))
    rate = 100.0 * F.col("bad") / F.col("n")
    return c.select("source", "dd", F.round(rate, 4).alias("rate"), F.when(rate >= 20, "high").when(rate >= 10, "elevated").otherwise("normal").alias("alert"))


@query("""WITH a AS (SELECT signal, d, value, lag(value, 7) OVER (PARTITION BY signal ORDER BY series.d) AS f FROM series WHERE category = 'demand') SELECT signal, CAST(d AS VARCHAR) AS dd, round((value - f) / f * 100, 4) AS deviation FROM a WHERE f IS NOT NULL""")
def mod_forecast_deviation(spark, d):
    f = F.lag("value", 7).over(Window.partitionBy("signal").orderBy("d"))
    a = series(spark, d).where("category = 'demand'").withColumn("f", f).where("f is not null")
    return a.select("signal", F.col("d").cast("string").alias("dd"), F.round((F.col("value") - F.col("f")) / F.col("f") * 100, 4).alias("deviation"))


@query("""WITH v AS (SELECT entity_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM obs GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY v.d DESC) AS k FROM v), a AS (SELECT entity_id, max(v) FILTER (WHERE k = 1) AS latest, avg(v) FILTER (WHERE k > 1) AS m, stddev_pop(v) FILTER (WHERE k > 1) AS s, count(*) AS n FROM t GROUP BY 1)
SELECT entity_id, round(latest, 6) AS latest, round((latest - m) / s, 4) AS z FROM a WHERE n >= 7 AND s >= 1 AND (latest - m) / s >= 2""")
def mod_attention_spikes(spark, d):
    v = obs(spark, d).groupBy("entity_id", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    t = v.withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("d"))))
    rest = F.when(F.col("k") > 1, F.col("v"))
    a = t.groupBy("entity_id").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("latest"), F.avg(rest).alias("m"), F.stddev_pop(rest).alias("s"), F.count("*").alias("n"))
    z = (F.col("latest") - F.col("m")) / F.col("s")
    return a.where("n >= 7 and s >= 1").where(z >= 2).select("entity_id", F.round("latest", 6).alias("latest"), F.round(z, 4).alias("z"))


@query(f"WITH {POINTS} SELECT zone, count(*) AS hotspots, round(sum(value), 5) AS frp, round(max(value), 6) AS strongest FROM pt JOIN zn ON lat BETWEEN zone_lat - 6 AND zone_lat + 6 AND lon BETWEEN zone_lon - 6 AND zone_lon + 6 GROUP BY 1")
def mod_fires_near_zones(spark, d):
    z = F.broadcast(zones(spark, d))  # one zone per nation
    p = points(spark, d)
    inside = p.lat.between(F.col("zone_lat") - 6, F.col("zone_lat") + 6) & p.lon.between(F.col("zone_lon") - 6, F.col("zone_lon") + 6)
    return ranked(p.join(z, inside), ["zone"], {"hotspots": F.count("*"), "frp": F.round(F.sum("value"), 5), "strongest": F.round(F.max("value"), 6)}, [F.desc("frp")])


@query("SELECT s_nationkey AS country, year(l_shipdate) AS y, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def mod_filing_trends(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return ranked(li.join(s, li.l_suppkey == s.s_suppkey), [F.col("s_nationkey").alias("country"), F.year("l_shipdate").alias("y")], {"n": F.count("*"), "v": F.round(F.sum("l_extendedprice"), 2)}, ["country", "y"])


@query("""WITH p AS (SELECT o_custkey AS cand, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS support, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS oppose FROM orders GROUP BY 1) SELECT cand, round(support, 2) AS support, round(oppose, 2) AS oppose, round((support - oppose) / greatest(support + oppose, 0.01), 6) AS balance FROM p""")
def mod_support_balance(spark, d):
    side = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0))
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cand")).agg(side("O").alias("a"), side("F").alias("b"))
    return p.select("cand", F.round("a", 2).alias("support"), F.round("b", 2).alias("oppose"), F.round((F.col("a") - F.col("b")) / F.greatest(F.col("a") + F.col("b"), F.lit(0.01)), 6).alias("balance"))


@query("SELECT brand, CAST(date_trunc('month', d) AS DATE)::VARCHAR AS m, round(avg(high - low), 5) AS spread, round(max(high - low), 6) AS widest FROM bars GROUP BY 1, 2")
def mod_pricing_spread(spark, d):
    gap = F.col("high") - F.col("low")
    return bars(spark, d).groupBy("brand", F.to_date(F.trunc("d", "month")).cast("string").alias("m")).agg(F.round(F.avg(gap), 5).alias("spread"), F.round(F.max(gap), 6).alias("widest"))


@query("SELECT entity_type, count(*) AS n FROM entities WHERE contains(lower(name), 'a') GROUP BY 1")
def mod_entity_search(spark, d):
    return ranked(search(entities(spark, d), ["name"], "A"), ["entity_type"], {"n": F.count("*")}, ["entity_type"])


@query("SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS tvl, round(100.0 * sum(s_acctbal) / sum(sum(s_acctbal)) OVER (), 4) AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def mod_chain_tvl(spark, d):
    """Value locked per chain: sums, counts and shares."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    g = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("v"))
    total = F.broadcast(g.agg(F.sum("v").alias("t")))  # one row
    return g.join(total).select("n_name", "suppliers", F.round("v", 2).alias("tvl"), F.round(100.0 * F.col("v") / F.col("t"), 4).alias("share"))


@query("""WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, CAST(d AS VARCHAR) AS dd, o_totalprice FROM k WHERE k <= 3""")
def mod_tvl_history(spark, d):
    """The newest three points of each series."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", k).where("k <= 3").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("dd"), "o_totalprice")


@query("""WITH i AS (SELECT source, date_trunc('hour', ts) AS h, sum(value) AS v FROM obs GROUP BY 1, 2) SELECT a.source AS src, b.source AS dst, count(*) AS hours, round(sum(a.v - b.v), 4) AS net FROM i a JOIN i b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2""")
def mod_interchange(spark, d):
    """Net flow between regions over the hours both report; the sources are few, so a pivot-free join by hour stays small."""
    i = obs(spark, d).groupBy("source", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v"))
    j = i.toDF("src", "h", "a").join(i.toDF("dst", "h", "b"), "h").where("src < dst")
    return j.groupBy("src", "dst").agg(F.count("*").alias("hours"), F.round(F.sum(F.col("a") - F.col("b")), 4).alias("net"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size >= 40) AS significant, count(*) AS docs, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def mod_agency_activity(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.count_if(F.col("p_size") >= 40).alias("significant"), F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dd FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 80")
def mod_upcoming(spark, d):
    o = search(table(spark, d, "orders"), [], where=(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O"), order=["o_orderdate", "o_orderkey"], limit=80)
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("dd"))


@query("SELECT wallet, count(*) AS trades, count(DISTINCT market) AS markets, round(sum(usdc), 2) AS volume, round(sum(CASE WHEN side = 'buy' THEN usdc ELSE -usdc END), 2) AS net FROM trades WHERE wallet IN (SELECT wallet FROM trades GROUP BY 1 ORDER BY round(sum(usdc), 2) DESC, wallet LIMIT 50) GROUP BY 1")
def mod_wallet_detail(spark, d):
    """Detail of the 50 largest wallets."""
    t = trades(spark, d)
    top = F.broadcast(t.groupBy("wallet").agg(F.round(F.sum("usdc"), 2).alias("v")).orderBy(F.desc("v"), "wallet").limit(50).select("wallet"))  # 50 rows
    net = F.sum(F.when(F.col("side") == "buy", F.col("usdc")).otherwise(-F.col("usdc")))
    return t.join(top, "wallet", "left_semi").groupBy("wallet").agg(F.count("*").alias("trades"), F.countDistinct("market").alias("markets"), F.round(F.sum("usdc"), 2).alias("volume"), F.round(net, 2).alias("net"))


@query("""WITH g AS (SELECT c_nationkey AS country, c_mktsegment AS kind, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2) SELECT country, kind, v, rank() OVER (PARTITION BY kind ORDER BY v DESC) AS place FROM g""")
def mod_holdings_ranking(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("kind")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("kind").orderBy(F.desc("v"))).cast("long"))


@query("""WITH y AS (SELECT s_nationkey AS c, year(l_shipdate) AS y, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), x AS (SELECT *, lag(v) OVER (PARTITION BY c ORDER BY y.y) AS p FROM y) SELECT c, x.y AS yr, v, round((v / p - 1) * 100, 4) AS yoy, coalesce((v / p - 1) * 100 <= -5, false) AS stress FROM x""")
def mod_yearly_stress(spark, d):
    """Yearly series of the statistics sources: change on the year and the stress flag."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    y = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("c"), F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("v"))
    pct = (F.col("v") / F.lag("v").over(Window.partitionBy("c").orderBy("yr")) - 1) * 100
    return y.withColumn("x", pct).select("c", "yr", "v", F.round("x", 4).alias("yoy"), F.coalesce(F.col("x") <= -5, F.lit(False)).alias("stress"))
