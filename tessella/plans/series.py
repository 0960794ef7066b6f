"""Window functions over series: deduplication, causal and rolling scores, trends and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_number
from ..registry import query
from .aggregates import shorts
from .views import bars, obs, obs_dup, positioning, series


def dedupe_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key: one aggregate with map-side combine, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), version).alias("_x")).select(*keys, "_x.*")


def before(keys: list[str], order: str, start=Window.unboundedPreceding, end: int = -1):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(start, end)


def z_against(value: Column, w, least: int, sample: bool = False, flat=None) -> Column:
    """(value - mean) / std of the rows in w, null below `least` rows, `flat` when the std vanishes."""
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    z = F.when(sd < 1e-12, F.lit(flat).cast("double")).otherwise((value - F.avg(value).over(w)) / (sd + (0.0 if sample else 1e-12)))
    return F.when(F.count(value).over(w) >= least, z)


def zsql(value: str, w: str, least: int, kind: str = "pop", flat: str = "NULL") -> str:
    eps = "" if kind == "samp" else " + 1e-12"
    return f"CASE WHEN count({value}) OVER {w} >= {least} THEN CASE WHEN stddev_{kind}({value}) OVER {w} < 1e-12 THEN {flat} ELSE ({value} - avg({value}) OVER {w}) / (stddev_{kind}({value}) OVER {w}{eps}) END END"


@query("""SELECT entity_id, epoch_us(ts) AS us, arg_max(value, id) AS value FROM obs_dup GROUP BY 1, 2""")
def win_dedupe_latest(spark, d):
    return dedupe_latest(obs_dup(spark, d).drop("source"), ["entity_id", "ts"], "id").select("entity_id", F.unix_micros("ts").alias("us"), "value")


@query("""WITH t AS (SELECT entity_id, CAST(ts AS DATE) AS d, value, source, row_number() OVER (PARTITION BY entity_id, CAST(ts AS DATE) ORDER BY source DESC, ts DESC, obs_id DESC) AS k FROM obs) SELECT entity_id, CAST(d AS VARCHAR) AS d, value, source FROM t WHERE k = 1""")
def win_multi_type_merge(spark, d):
    o = obs(spark, d).withColumn("d", F.to_date("ts"))
    best = o.groupBy("entity_id", "d").agg(F.max_by(F.struct("value", "source"), F.struct("source", "ts", "obs_id")).alias("x"))
    return best.select("entity_id", F.col("d").cast("string").alias("d"), "x.value", "x.source")


WZ = "(PARTITION BY entity_id ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def event_scores(spark, d):
    """Every observation against the earlier ones of its entity."""
    o = obs(spark, d).withColumn("at", F.struct("ts", "obs_id"))
    return o.withColumn("z", z_against(F.col("value"), before(["entity_id"], "at"), 19)).drop("at")


@query(f"SELECT * FROM (SELECT entity_id, obs_id, round({zsql('value', WZ, 19)}, 6) AS z FROM obs) WHERE abs(z) >= 2")
def win_event_zscore(spark, d):
    return event_scores(spark, d).select("entity_id", "obs_id", F.round("z", 6).alias("z")).where("abs(z) >= 2")


@query(f"WITH s AS (SELECT entity_id, obs_id, ts, {zsql('value', WZ, 19)} AS z, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, obs_id DESC) AS k FROM obs) SELECT entity_id, obs_id, round(z, 2) AS z FROM s WHERE k = 1 AND z IS NOT NULL")
def win_causal_zscore(spark, d):
    last = event_scores(spark, d).groupBy("entity_id").agg(F.max_by(F.struct("obs_id", "z"), F.struct("ts", "obs_id")).alias("x"))
    return last.select("entity_id", "x.obs_id", F.round("x.z", 2).alias("z")).where("z is not null")


W52 = "(PARTITION BY brand ORDER BY week ROWS BETWEEN 51 PRECEDING AND 1 PRECEDING)"


@query(f"SELECT brand, CAST(week AS VARCHAR) AS wk, round(coalesce({zsql('longs', W52, 3, 'samp', '0')}, 0), 6) AS z FROM positioning")
def win_rolling_zscore(spark, d):
    z = z_against(F.col("longs"), before(["brand"], "week", -51), 3, sample=True, flat=0.0)
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), F.round(F.coalesce(z, F.lit(0.0)), 6).alias("z"))


@query("""WITH t AS (SELECT signal, value, series.d, row_number() OVER (PARTITION BY signal ORDER BY series.d DESC) AS k FROM series), w AS (SELECT * FROM t WHERE k <= 60), l AS (SELECT signal, value AS latest FROM w WHERE k = 1),
a AS (SELECT w.signal, any_value(latest) AS latest, avg(value) AS m, stddev_samp(value) AS s, avg(CASE WHEN value <= latest THEN 1 ELSE 0 END) AS pct FROM w JOIN l ON l.signal = w.signal GROUP BY 1)
SELECT signal, latest, round(CASE WHEN s < 1e-12 THEN 0 ELSE (latest - m) / s END, 6) AS z, round(pct, 6) AS pct, abs(CASE WHEN s < 1e-12 THEN 0 ELSE (latest - m) / s END) > 2 OR pct < 0.05 OR pct > 0.95 AS anomaly FROM a""")
def win_atomic_signal(spark, d):
    recent = series(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("d")))).where("k <= 60")
    w = recent.withColumn("latest", F.first("value").over(Window.partitionBy("signal").orderBy("k")))
    a = w.groupBy("signal").agg(F.first("latest").alias("latest"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.avg(F.when(F.col("value") <= F.col("latest"), 1).otherwise(0)).alias("pct"))
    z = F.when(F.col("s") < 1e-12, 0.0).otherwise((F.col("latest") - F.col("m")) / F.col("s"))
    return a.select("signal", "latest", F.round(z, 6).alias("z"), F.round("pct", 6).alias("pct"), ((F.abs(z) > 2) | (F.col("pct") < 0.05) | (F.col("pct") > 0.95)).alias("anomaly"))


@query("""WITH p AS (SELECT brand, week, longs, list(longs) OVER (PARTITION BY brand ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS w FROM positioning)
SELECT brand, CAST(week AS VARCHAR) AS wk, CASE WHEN len(w) < 2 THEN 0.5 ELSE round(len(list_filter(w, lambda x: x < longs)) / (len(w) - 1), 4) END AS rank FROM p""")
def win_rolling_percentile_rank(spark, d):
    w = F.collect_list("longs").over(Window.partitionBy("brand").orderBy("week").rowsBetween(-51, 0))
    p = positioning(spark, d).withColumn("w", w)
    rank = F.expr("size(filter(w, x -> x < longs)) / (size(w) - 1)")
    return p.select("brand", F.col("week").cast("string").alias("wk"), F.when(F.size("w") < 2, 0.5).otherwise(F.round(rank, 4)).alias("rank"))


@query("SELECT brand, CAST(week AS VARCHAR) AS wk, CAST(coalesce(sign(longs - lag(longs) OVER (PARTITION BY brand ORDER BY positioning.week)), 0) AS DOUBLE) AS dir FROM positioning")
def win_direction_change(spark, d):
    w = Window.partitionBy("brand").orderBy("week")
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), F.coalesce(F.signum(F.col("longs") - F.lag("longs").over(w)), F.lit(0.0)).alias("dir"))


@query("SELECT brand, CAST(week AS VARCHAR) AS wk, round(coalesce(oi / avg(oi) OVER (PARTITION BY brand ORDER BY positioning.week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), 1.0), 6) AS ratio FROM positioning")
def win_oi_vs_average(spark, d):
    w = Window.partitionBy("brand").orderBy("week").rowsBetween(-51, 0)
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), F.round(F.coalesce(F.col("oi") / F.avg("oi").over(w), F.lit(1.0)), 6).alias("ratio"))


@query("SELECT brand, CAST(d AS VARCHAR) AS d, round(ret, 6) AS ret FROM bars")
def win_log_return(spark, d):
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("d"), F.round("ret", 6).alias("ret"))


WB = "(PARTITION BY brand ORDER BY bars.d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def last20():
    return Window.partitionBy("brand").orderBy("d").rowsBetween(-19, 0)


@query(f"SELECT brand, CAST(d AS VARCHAR) AS dd, round(CASE WHEN count(ret) OVER {WB} >= 2 THEN stddev_pop(ret) OVER {WB} * sqrt(252) END, 6) AS vol FROM bars")
def win_realised_vol_20d(spark, d):
    vol = F.when(F.count("ret").over(last20()) >= 2, F.stddev_pop("ret").over(last20()) * (252**0.5))
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round(vol, 6).alias("vol"))


@query(f"SELECT brand, CAST(d AS VARCHAR) AS dd, round(avg(volume) OVER {WB}, 6) AS volume FROM bars")
def win_avg_volume_20d(spark, d):
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round(F.avg("volume").over(last20()), 6).alias("volume"))


@query("""WITH f AS (SELECT brand, d, close, row_number() OVER o AS n, close / lag(close, 21) OVER o - 1 AS m21, close / lag(close, 63) OVER o - 1 AS m63, close / lag(close, 126) OVER o - 1 AS m126,
stddev_samp(ret) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20, stddev_samp(ret) OVER (o ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v60, avg(volume) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS av,
list(close) OVER (o ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS cs, avg(ret) OVER (o ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS mr FROM bars WINDOW o AS (PARTITION BY brand ORDER BY bars.d)),
l AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY f.d DESC) AS k FROM f)
SELECT brand, round(m21, 6) AS m21, round(m63, 6) AS m63, round(m126, 6) AS m126, round(v20, 6) AS v20, round(v60, 6) AS v60, round(av, 6) AS av, round(mr / v60 * sqrt(252), 6) AS sharpe,
round(list_min(list_transform(range(1, len(cs) + 1), lambda i: cs[i] / list_max(cs[1:i]) - 1)), 6) AS drawdown FROM l WHERE k = 1""")
def win_price_features(spark, d):
    w = Window.partitionBy("brand").orderBy("d")
    last = lambda n: w.rowsBetween(-n + 1, 0)
    f = bars(spark, d).select(
        "brand", "d", *[(F.col("close") / F.lag("close", n).over(w) - 1).alias(f"m{n}") for n in (21, 63, 126)], F.stddev_samp("ret").over(last(20)).alias("v20"), F.stddev_samp("ret").over(last(60)).alias("v60"),
        F.avg("volume").over(last(20)).alias("av"), F.collect_list("close").over(last(60)).alias("cs"), F.avg("ret").over(last(60)).alias("mr"),
    )
    one = f.groupBy("brand").agg(F.max_by(F.struct("m21", "m63", "m126", "v20", "v60", "av", "cs", "mr"), "d").alias("x")).select("brand", "x.*")
    # running maximum and lowest ratio to it, in one fold
    drop = F.expr("aggregate(cs, named_struct('top', cast(0 as double), 'low', cast(0 as double)), (a, c) -> named_struct('top', greatest(a.top, c), 'low', least(a.low, c / greatest(a.top, c) - 1)), a -> a.low)")
    return one.select("brand", *[F.round(c, 6).alias(c) for c in ("m21", "m63", "m126", "v20", "v60", "av")], F.round(F.col("mr") / F.col("v60") * (252**0.5), 6).alias("sharpe"), F.round(drop, 6).alias("drawdown"))


@query("SELECT brand, CAST(d AS VARCHAR) AS dd, round((close - avg(close) OVER w) / greatest(coalesce(stddev_samp(close) OVER w, 0), 1e-8), 5) AS z FROM bars WINDOW w AS (PARTITION BY bars.d)")
def win_cross_section_normalise(spark, d):
    w = Window.partitionBy("d")
    z = (F.col("close") - F.avg("close").over(w)) / F.greatest(F.coalesce(F.stddev_samp("close").over(w), F.lit(0.0)), F.lit(1e-8))
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round(z, 5).alias("z"))


@query("""WITH t AS (SELECT signal, value, row_number() OVER (PARTITION BY signal ORDER BY series.d DESC) AS k FROM series), a AS (SELECT signal, max(value) FILTER (WHERE k = 1) AS latest, avg(value) FILTER (WHERE k > 1) AS m, stddev_pop(value) FILTER (WHERE k > 1) AS s, count(*) AS n FROM t GROUP BY 1)
SELECT signal, latest, round(CASE WHEN s < 1 THEN CASE WHEN latest >= 200 AND (m < 1 OR latest >= 2 * m) THEN 99 ELSE 0 END ELSE (latest - m) / s END, 6) AS z FROM a WHERE n >= 7""")
def win_spike_detect(spark, d):
    t = series(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("d"))))
    rest = F.when(F.col("k") > 1, F.col("value"))
    a = t.groupBy("signal").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("latest"), F.avg(rest).alias("m"), F.stddev_pop(rest).alias("s"), F.count("*").alias("n")).where("n >= 7")
    z = F.expr("case when s < 1 then case when latest >= 200 and (m < 1 or latest >= 2 * m) then 99 else 0 end else (latest - m) / s end")
    return a.select("signal", "latest", F.round(z, 6).alias("z"))


@query("""WITH s AS (SELECT p_brand, CAST(l_shipdate AS DATE) AS d, CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) END AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
z AS (SELECT *, (q - avg(q) OVER (PARTITION BY p_brand)) / stddev_samp(q) OVER (PARTITION BY p_brand) AS z, row_number() OVER (PARTITION BY p_brand ORDER BY s.d) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM s)
SELECT p_brand, count(*) FILTER (WHERE abs(z) > 1.5) AS anomalies, CASE WHEN avg(q) FILTER (WHERE k > n // 2) - avg(q) FILTER (WHERE k <= n // 2) > 0.02 THEN 'rising' WHEN avg(q) FILTER (WHERE k > n // 2) - avg(q) FILTER (WHERE k <= n // 2) < -0.02 THEN 'falling' ELSE 'stable' END AS trend FROM z GROUP BY 1""")
def win_short_ratio_anomaly(spark, d):
    s = shorts(spark, d, ["p_brand", F.to_date("l_shipdate").alias("d")]).withColumnRenamed("short_ratio", "q")
    w = Window.partitionBy("p_brand")
    z = s.withColumn("z", (F.col("q") - F.avg("q").over(w)) / F.stddev_samp("q").over(w)).withColumn("k", F.row_number().over(w.orderBy("d"))).withColumn("n", F.count("*").over(w))
    late = F.col("k") > F.expr("n div 2")
    g = z.groupBy("p_brand").agg(F.count_if(F.abs("z") > 1.5).alias("anomalies"), (F.avg(F.when(late, F.col("q"))) - F.avg(F.when(~late, F.col("q")))).alias("m"))
    return g.select("p_brand", "anomalies", F.when(F.col("m") > 0.02, "rising").when(F.col("m") < -0.02, "falling").otherwise("stable").alias("trend"))


@query("""WITH s AS (SELECT o_custkey AS c, date_trunc('quarter', o_orderdate) AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY q DESC) AS k FROM s), a AS (SELECT c, max(v) FILTER (WHERE k = 1) AS latest, avg(v) FILTER (WHERE k > 1) AS m, count(*) AS n FROM t GROUP BY 1)
SELECT c, round(latest / m, 6) AS ratio, latest / m >= 2 AS anomaly FROM a WHERE n >= 2 AND m > 0""")
def win_spend_anomaly(spark, d):
    from .views import table

    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("v"))
    t = s.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("q"))))
    a = t.groupBy("c").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("latest"), F.avg(F.when(F.col("k") > 1, F.col("v"))).alias("m"), F.count("*").alias("n")).where("n >= 2 and m > 0")
    return a.select("c", F.round(F.col("latest") / F.col("m"), 6).alias("ratio"), (F.col("latest") / F.col("m") >= 2).alias("anomaly"))


def change_sql(days: int) -> str:
    return f"""(SELECT b.close FROM bars b WHERE b.brand = l.brand AND b.d <= l.d - {days} ORDER BY b.d DESC LIMIT 1)"""


@query(f"""WITH l AS (SELECT brand, max(d) AS d, arg_max(close, bars.d) AS close FROM bars GROUP BY 1) SELECT brand, round((close / {change_sql(7)} - 1) * 100, 2) AS c7, round((close / {change_sql(30)} - 1) * 100, 2) AS c30, round((close / {change_sql(365)} - 1) * 100, 2) AS c365 FROM l""")
def win_percentage_changes(spark, d):
    return changes(bars(spark, d), (7, 30, 365))


def changes(b: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """Percent change of the last value against the newest one at least n days before it."""
    last = Window.partitionBy("brand")
    x = b.withColumn("end", F.max("d").over(last))
    g = x.groupBy("brand").agg(F.max_by("close", "d").alias("c"), *[F.max_by(F.when(F.col("d") <= F.date_sub("end", n), F.col("close")), F.when(F.col("d") <= F.date_sub("end", n), F.col("d"))).alias(f"p{n}") for n in spans])
    return g.select("brand", *[F.round((F.col("c") / F.col(f"p{n}") - 1) * 100, 2).alias(f"c{n}") for n in spans])


@query(f"""WITH l AS (SELECT brand, max(d) AS d, arg_max(close, bars.d) AS close FROM bars GROUP BY 1), g AS (SELECT brand, round((close / {change_sql(90)} - 1) * 100, 2) AS c90 FROM l) SELECT brand, round(c90 * 365 / 90, 4) AS annualised FROM g""")
def win_annualised_growth(spark, d):
    return changes(bars(spark, d), (90,)).select("brand", F.round(F.col("c90") * 365 / 90, 4).alias("annualised"))


@query("""WITH t AS (SELECT brand, positioning.week, oi, coalesce(lag(oi, 3) OVER w, first_value(oi) OVER w) AS p FROM positioning WINDOW w AS (PARTITION BY brand ORDER BY positioning.week)) SELECT brand, CAST(t.week AS VARCHAR) AS wk, round((oi / p - 1) * 100, 4) AS change, oi / p - 1 < -0.05 AS stress FROM t""")
def win_reserve_stress(spark, d):
    w = Window.partitionBy("brand").orderBy("week")
    p = F.coalesce(F.lag("oi", 3).over(w), F.first("oi").over(w))
    return positioning(spark, d).withColumn("p", p).select("brand", F.col("week").cast("string").alias("wk"), F.round((F.col("oi") / F.col("p") - 1) * 100, 4).alias("change"), (F.col("oi") / F.col("p") - 1 < -0.05).alias("stress"))


@query("SELECT brand, CAST(week AS VARCHAR) AS wk, CASE WHEN oi > 1.05 * lag(oi, 3) OVER w THEN 'rising' WHEN oi < 0.95 * lag(oi, 3) OVER w THEN 'falling' ELSE 'flat' END AS trend FROM positioning WINDOW w AS (PARTITION BY brand ORDER BY positioning.week)")
def win_trend_direction(spark, d):
    p = F.lag("oi", 3).over(Window.partitionBy("brand").orderBy("week"))
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), F.when(F.col("oi") > 1.05 * p, "rising").when(F.col("oi") < 0.95 * p, "falling").otherwise("flat").alias("trend"))


@query("""WITH t AS (SELECT brand, positioning.week, CASE WHEN oi < lag(oi) OVER w THEN 0 ELSE 1 END AS brk FROM positioning WINDOW w AS (PARTITION BY brand ORDER BY positioning.week)),
i AS (SELECT brand, t.week, sum(brk) OVER (PARTITION BY brand ORDER BY t.week) AS isl FROM t), m AS (SELECT brand, max(isl) AS isl FROM i GROUP BY 1) SELECT i.brand, count(*) - 1 AS declines FROM i JOIN m ON m.brand = i.brand AND m.isl = i.isl GROUP BY 1""")
def win_consecutive_declines(spark, d):
    return trailing_run(positioning(spark, d), ["brand"], "week", lambda w: F.col("oi") < F.lag("oi").over(w), "declines")


def trailing_run(df: DataFrame, keys: list[str], order: str, holds, name: str) -> DataFrame:
    """Length of the run of rows at the end of each key for which holds(window) is true: rows after the last break."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = df.withColumn("_brk", ~F.coalesce(holds(w), F.lit(False))).withColumn("_n", F.row_number().over(w))
    return t.groupBy(*keys).agg((F.max("_n") - F.coalesce(F.max(F.when(F.col("_brk"), F.col("_n"))), F.lit(0))).cast("long").alias(name))


@query("""WITH t AS (SELECT brand, positioning.week, oi, lag(oi) OVER w AS p, row_number() OVER w AS n FROM positioning WINDOW w AS (PARTITION BY brand ORDER BY positioning.week)),
b AS (SELECT brand, max(n) - coalesce(max(n) FILTER (WHERE NOT coalesce(oi > p, false)), 0) AS builds, max(n) - coalesce(max(n) FILTER (WHERE NOT coalesce(oi < p, false)), 0) AS draws, avg(oi) AS mean, max(oi) AS peak, min(oi) AS trough, arg_max(oi, n) AS latest, arg_max(oi - p, n) AS change FROM t GROUP BY 1)
SELECT brand, latest, round(mean, 6) AS mean, peak, trough, round(change, 6) AS change, builds, draws, abs(change) > 5000 OR greatest(builds, draws) >= 3 AS alert FROM b""")
def win_stock_signals(spark, d):
    w = Window.partitionBy("brand").orderBy("week")
    t = positioning(spark, d).withColumn("p", F.lag("oi").over(w)).withColumn("n", F.row_number().over(w))
    run = lambda up: (F.max("n") - F.coalesce(F.max(F.when(~F.coalesce(up, F.lit(False)), F.col("n"))), F.lit(0))).cast("long")
    b = t.groupBy("brand").agg(F.max_by("oi", "n").alias("latest"), F.avg("oi").alias("mean"), F.max("oi").alias("peak"), F.min("oi").alias("trough"), F.max_by(F.col("oi") - F.col("p"), "n").alias("change"), run(F.col("oi") > F.col("p")).alias("builds"), run(F.col("oi") < F.col("p")).alias("draws"))
    return b.select("brand", "latest", F.round("mean", 6).alias("mean"), "peak", "trough", F.round("change", 6).alias("change"), "builds", "draws", ((F.abs("change") > 5000) | (F.greatest("builds", "draws") >= 3)).alias("alert"))


@query("""WITH m AS (SELECT o_orderpriority AS s, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS v FROM orders GROUP BY 1, 2), x AS (SELECT *, v - lag(v) OVER w AS c1, v - lag(v, 6) OVER w AS c6 FROM m WINDOW w AS (PARTITION BY s ORDER BY m.m))
SELECT s, CAST(m AS VARCHAR) AS mm, CASE WHEN v > 40 THEN CASE WHEN c1 >= 0 THEN 'expanding' ELSE 'slowing' END ELSE CASE WHEN c1 < 0 THEN 'contracting' ELSE 'recovering' END END AS regime, c6 AS momentum FROM x WHERE c1 IS NOT NULL""")
def win_leading_indicator_regime(spark, d):
    from .views import table

    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("s"), F.to_date(F.trunc("o_orderdate", "month")).alias("m")).agg(F.count("*").alias("v"))
    w = Window.partitionBy("s").orderBy("m")
    x = m.withColumn("c1", F.col("v") - F.lag("v").over(w)).withColumn("momentum", F.col("v") - F.lag("v", 6).over(w)).where("c1 is not null")
    regime = F.when(F.col("v") > 40, F.when(F.col("c1") >= 0, "expanding").otherwise("slowing")).otherwise(F.when(F.col("c1") < 0, "contracting").otherwise("recovering"))
    return x.select("s", F.col("m").cast("string").alias("mm"), regime.alias("regime"), "momentum")


@query(f"""WITH l AS (SELECT brand, max(d) AS d, arg_max(close, bars.d) AS close, count(*) AS n FROM bars GROUP BY 1) SELECT brand, round((close - {change_sql(30)}) * 100, 4) AS bps, CASE WHEN n >= 1000 THEN 1.0 ELSE 0.5 END AS quality FROM l""")
def win_rate_momentum(spark, d):
    x = bars(spark, d).withColumn("end", F.max("d").over(Window.partitionBy("brand")))
    old = F.col("d") <= F.date_sub("end", 30)
    g = x.groupBy("brand").agg(F.max_by("close", "d").alias("c"), F.max_by(F.when(old, F.col("close")), F.when(old, F.col("d"))).alias("p"), F.count("*").alias("n"))
    return g.select("brand", F.round((F.col("c") - F.col("p")) * 100, 4).alias("bps"), F.when(F.col("n") >= 1000, 1.0).otherwise(0.5).alias("quality"))


@query("SELECT round((arg_max(value, d) FILTER (WHERE signal = 'priority.5-LOW') - arg_max(value, d) FILTER (WHERE signal = 'priority.1-URGENT')) * 100, 4) AS slope FROM series")
def win_yield_slope(spark, d):
    one = lambda s: F.max_by(F.when(F.col("signal") == s, F.col("value")), F.when(F.col("signal") == s, F.col("d")))
    return series(spark, d).where("category = 'urgency'").agg(F.round((one("priority.5-LOW") - one("priority.1-URGENT")) * 100, 4).alias("slope"))


@query("""WITH t AS (SELECT brand, positioning.week, oi - lag(oi, 4) OVER (PARTITION BY brand ORDER BY positioning.week) AS x FROM positioning) SELECT brand, round(least(10, greatest(-10, (arg_max(x, week) - avg(x)) / stddev_samp(x))), 6) AS z, least(1.0, count(x) / 100.0) AS quality FROM t GROUP BY 1""")
def win_liquidity_pressure(spark, d):
    t = positioning(spark, d).withColumn("x", F.col("oi") - F.lag("oi", 4).over(Window.partitionBy("brand").orderBy("week")))
    z = (F.max_by("x", "week") - F.avg("x")) / F.stddev_samp("x")
    return t.groupBy("brand").agg(F.round(F.least(F.lit(10.0), F.greatest(F.lit(-10.0), z)), 6).alias("z"), F.least(F.lit(1.0), F.count("x") / 100.0).alias("quality"))


@query("""WITH g AS (SELECT signal, CAST(w AS DATE) AS w FROM (SELECT DISTINCT signal FROM series), generate_series(TIMESTAMP '1996-01-03', TIMESTAMP '1999-12-29', INTERVAL 7 DAY) t(w)),
f AS (SELECT g.signal, g.w, (SELECT value FROM series s WHERE s.signal = g.signal AND s.d <= g.w ORDER BY s.d DESC LIMIT 1) AS v FROM g), x AS (SELECT signal, f.w, v - lag(v) OVER (PARTITION BY signal ORDER BY f.w) AS c FROM f)
SELECT signal, CAST(x.w AS VARCHAR) AS wk, round(CASE WHEN count(c) OVER o = 52 THEN (c - avg(c) OVER o) / nullif(stddev_samp(c) OVER o, 0) END, 5) AS z FROM x WINDOW o AS (PARTITION BY signal ORDER BY x.w ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)""")
def win_liquidity_composite(spark, d):
    from ..operators.joins import asof_join

    s = series(spark, d).select("signal", "d", "value")
    weeks = spark.range(209).select(F.expr("date_add(date '1996-01-03', cast(id * 7 as int))").alias("w")).where("w <= date '1999-12-29'")
    grid = s.select("signal").distinct().join(F.broadcast(weeks))  # 208 rows
    f = asof_join(grid, s, ["signal"], "w", "d", "value").withColumn("v", F.col("found.value"))
    w = Window.partitionBy("signal").orderBy("w")
    x = f.withColumn("c", F.col("v") - F.lag("v").over(w))
    o = w.rowsBetween(-51, 0)
    return x.select("signal", F.col("w").cast("string").alias("wk"), F.round(F.when(F.count("c").over(o) == 52, (F.col("c") - F.avg("c").over(o)) / F.nullif(F.stddev_samp("c").over(o), F.lit(0.0))), 5).alias("z"))


WBASE = "(PARTITION BY entity_id ORDER BY ts, obs_id ROWS BETWEEN 34 PRECEDING AND 5 PRECEDING)"


@query(f"SELECT obs_id, round({zsql('value', WBASE, 10, 'samp', '0')}, 6) AS z FROM obs")
def win_entity_baseline(spark, d):
    """Against a window of 30 that ends 5 rows before the current one."""
    o = obs(spark, d).withColumn("at", F.struct("ts", "obs_id"))
    return o.select("obs_id", F.round(z_against(F.col("value"), before(["entity_id"], "at", -34, -5), 10, sample=True, flat=0.0), 6).alias("z"))


@query(f"WITH z AS (SELECT entity_id, CAST(ts AS DATE) AS d, {zsql('value', WBASE, 10, 'samp', '0')} AS z FROM obs) SELECT entity_id, round(sum(z), 5) AS car FROM z WHERE d >= DATE '2024-01-15' GROUP BY 1")
def win_cumulative_abnormal(spark, d):
    o = obs(spark, d).withColumn("at", F.struct("ts", "obs_id"))
    z = o.withColumn("z", z_against(F.col("value"), before(["entity_id"], "at", -34, -5), 10, sample=True, flat=0.0)).where("to_date(ts) >= date '2024-01-15'")
    return z.groupBy("entity_id").agg(F.round(F.sum("z"), 5).alias("car"))


@query("""WITH c AS (SELECT brand, bars.d, exp(sum(coalesce(ret, 0)) OVER (PARTITION BY brand ORDER BY bars.d ROWS UNBOUNDED PRECEDING)) AS e FROM bars) SELECT brand, CAST(c.d AS VARCHAR) AS dd, round(e / max(e) OVER (PARTITION BY brand ORDER BY c.d ROWS UNBOUNDED PRECEDING) - 1, 6) AS dd_ratio FROM c""")
def win_drawdown_path(spark, d):
    w = Window.partitionBy("brand").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    c = bars(spark, d).withColumn("e", F.exp(F.sum(F.coalesce("ret", F.lit(0.0))).over(w)))
    return c.select("brand", F.col("d").cast("string").alias("dd"), F.round(F.col("e") / F.max("e").over(w) - 1, 6).alias("dd_ratio"))


@query("SELECT brand, CAST(d AS VARCHAR) AS dd, round(avg(ret) OVER o / greatest(stddev_pop(ret) OVER o, 1e-8) * sqrt(52), 6) AS sharpe FROM bars WHERE ret IS NOT NULL WINDOW o AS (PARTITION BY brand ORDER BY bars.d ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER o = 52")
def win_rolling_sharpe(spark, d):
    o = Window.partitionBy("brand").orderBy("d").rowsBetween(-51, 0)
    x = bars(spark, d).where("ret is not null").withColumn("n", F.count("*").over(o)).withColumn("s", F.avg("ret").over(o) / F.greatest(F.stddev_pop("ret").over(o), F.lit(1e-8)) * (52**0.5))
    return x.where("n = 52").select("brand", F.col("d").cast("string").alias("dd"), F.round("s", 6).alias("sharpe"))


@query("SELECT obs_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - lag(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) OVER (PARTITION BY entity_id ORDER BY ts, obs_id) AS step FROM obs")
def win_payload_step(spark, d):
    x = first_number(F.col("props"), ["k"])
    return obs(spark, d).select("obs_id", (x - F.lag(x).over(Window.partitionBy("entity_id").orderBy("ts", "obs_id"))).alias("step"))
