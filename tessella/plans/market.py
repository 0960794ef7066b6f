"""Market microstructure over daily bars."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds
from ..registry import query
from .convergence import normal_cdf_sql
from .joining import STRESS, stress
from .views import bars, positioning


def by_brand():
    return Window.partitionBy("brand").orderBy("d")


@query("""WITH b AS (SELECT brand, bars.d, pow(ln(high / low), 2) AS beta, CASE WHEN lag(high) OVER w IS NOT NULL THEN pow(ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)), 2) END AS gamma FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)),
a AS (SELECT *, least(10, greatest(-10, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))))) AS alpha FROM b WHERE gamma IS NOT NULL)
SELECT brand, CAST(d AS VARCHAR) AS dd, round(greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))), 6) AS spread FROM a""")
def mkt_corwin_schultz(spark, d):
    w = by_brand()
    k = 3 - 2 * math.sqrt(2)
    beta = F.pow(F.log(F.col("high") / F.col("low")), 2)
    gamma = F.pow(F.log(F.greatest("high", F.lag("high").over(w)) / F.least("low", F.lag("low").over(w))), 2)
    b = bars(spark, d).withColumn("beta", beta).withColumn("gamma", F.when(F.lag("high").over(w).isNotNull(), gamma)).where("gamma is not null")
    alpha = F.least(F.lit(10.0), F.greatest(F.lit(-10.0), (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(F.col("gamma") / k)))
    e = F.exp(alpha)
    return b.select("brand", F.col("d").cast("string").alias("dd"), F.round(F.greatest(F.lit(0.0), 2 * (e - 1) / (1 + e)), 6).alias("spread"))


@query("""WITH c AS (SELECT brand, bars.d, ret - avg(ret) OVER (PARTITION BY brand) AS c FROM bars WHERE ret IS NOT NULL), p AS (SELECT brand, c * lag(c) OVER (PARTITION BY brand ORDER BY c.d) AS p FROM c), v AS (SELECT brand, avg(p) AS cov FROM p GROUP BY 1)
SELECT brand, round(CASE WHEN cov >= 0 THEN 0 ELSE 2 * sqrt(-cov) END, 6) AS spread FROM v""")
def mkt_roll_spread(spark, d):
    c = bars(spark, d).where("ret is not null").withColumn("c", F.col("ret") - F.avg("ret").over(Window.partitionBy("brand")))
    v = c.withColumn("p", F.col("c") * F.lag("c").over(by_brand())).groupBy("brand").agg(F.avg("p").alias("cov"))
    return v.select("brand", F.round(F.when(F.col("cov") >= 0, 0.0).otherwise(2 * F.sqrt(-F.col("cov"))), 6).alias("spread"))


def flows(spark, d):
    """Signed volume of each bar by the normal cdf of its price move over the last 12 bars' deviation."""
    prior = by_brand().rowsBetween(-12, -1)
    b = bars(spark, d).withColumn("sd", F.stddev_samp("close").over(prior)).withColumn("move", F.last("close").over(prior) - F.first("close").over(prior)).withColumn("vol", F.sum("volume").over(prior)).withColumn("k", F.count("close").over(prior))
    b = b.where("k = 12")
    buy = S.normal_cdf(F.when(F.col("sd") > 0, F.col("move") / F.col("sd")).otherwise(0.0))
    return b.withColumn("ofi", F.col("vol") * (2 * buy - 1))


FLOWS = f"""fl0 AS (SELECT brand, bars.d, stddev_samp(close) OVER w AS sd, last_value(close) OVER w - first_value(close) OVER w AS mv, sum(volume) OVER w AS vol, count(close) OVER w AS k FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
fl1 AS (SELECT brand, d, vol, CASE WHEN sd > 0 THEN mv / sd ELSE 0.0 END AS x FROM fl0 WHERE k = 12), fl AS (SELECT brand, d, vol * (2 * {normal_cdf_sql('x')} - 1) AS ofi FROM fl1)"""


@query(f"WITH {FLOWS} SELECT brand, CAST(d AS VARCHAR) AS dd, round(ofi, 4) AS ofi FROM fl")
def mkt_order_flow_imbalance(spark, d):
    return flows(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round("ofi", 4).alias("ofi"))


@query(f"WITH {FLOWS} SELECT brand, CAST(d AS VARCHAR) AS dd, round((ofi - avg(ofi) OVER w) / nullif(stddev_samp(ofi) OVER w, 0), 4) AS z FROM fl WINDOW w AS (PARTITION BY brand ORDER BY fl.d ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)")
def mkt_ofi_zscore(spark, d):
    w = by_brand().rowsBetween(-720, -1)
    z = (F.col("ofi") - F.avg("ofi").over(w)) / F.nullif(F.stddev_samp("ofi").over(w), F.lit(0.0))
    return flows(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round(z, 4).alias("z"))


BUCKETS = """WITH RECURSIVE o AS (SELECT brand, close, volume, row_number() OVER (PARTITION BY brand ORDER BY bars.d) AS n FROM bars),
r AS (SELECT brand, n, close, volume AS acc, 1 AS bucket, volume >= 2000 AS closed FROM o WHERE n = 1 UNION ALL SELECT o.brand, o.n, o.close, CASE WHEN r.closed THEN o.volume ELSE r.acc + o.volume END, r.bucket + CASE WHEN r.closed THEN 1 ELSE 0 END,
CASE WHEN r.closed THEN o.volume ELSE r.acc + o.volume END >= 2000 FROM r JOIN o ON o.brand = r.brand AND o.n = r.n + 1),
bk AS (SELECT brand, bucket, max(acc) AS volume, arg_min(close, n) AS open, arg_max(close, n) AS close, max(close) AS high, min(close) AS low, count(*) AS bars, bool_or(closed) AS full_ FROM r GROUP BY 1, 2)"""


def volume_buckets(spark, d, size: float = 2000.0):
    """A bucket closes when its volume reaches size; the overshoot stays in it and the next starts from 0."""

    def step(prev, volume):
        acc, bucket, closed = prev
        state = (volume, bucket + 1) if closed else (acc + volume, bucket)
        return (*state, state[0] >= size), (*state, state[0] >= size)

    r = folds.fold(bars(spark, d).select("brand", "d", "close", "volume"), ["brand"], ["d", "close"], ["volume"], "acc double, bucket int, closed boolean", (0.0, 1, False), step)
    return r.groupBy("brand", "bucket").agg(F.max("acc").alias("volume"), F.min_by("close", "d").alias("open"), F.max_by("close", "d").alias("close"), F.max("close").alias("high"), F.min("close").alias("low"), F.count("*").alias("bars"), F.bool_or("closed").alias("full_"))


@query(f"{BUCKETS} SELECT * FROM bk WHERE full_")
def mkt_volume_buckets(spark, d):
    return volume_buckets(spark, d).where("full_")


def classified(spark, d):
    b = volume_buckets(spark, d).where("full_")
    half = (F.col("high") - F.col("low")) / 2
    return b.withColumn("buy", F.col("volume") * S.normal_cdf(F.when(half > 0, (F.col("close") - F.col("open")) / half).otherwise(0.0)))


CLASSIFIED = f"""{BUCKETS}, ks AS (SELECT *, CASE WHEN high > low THEN (close - open) / ((high - low) / 2) ELSE 0.0 END AS x FROM bk WHERE full_), cl AS (SELECT brand, bucket, volume, volume * {normal_cdf_sql('x')} AS buy FROM ks)"""


@query(f"{CLASSIFIED} SELECT brand, bucket, round(buy, 4) AS buy, round(volume - buy, 4) AS sell FROM cl")
def mkt_bulk_classification(spark, d):
    c = classified(spark, d)
    return c.select("brand", "bucket", F.round("buy", 4).alias("buy"), F.round(F.col("volume") - F.col("buy"), 4).alias("sell"))


def vpin(spark, d, n: int = 20):
    w = Window.partitionBy("brand").orderBy("bucket").rowsBetween(-(n - 1), 0)
    c = classified(spark, d).withColumn("gap", F.abs(2 * F.col("buy") - F.col("volume")))
    return c.withColumn("k", F.count("*").over(w)).withColumn("vpin", F.sum("gap").over(w) / F.sum("volume").over(w)).where(f"k = {n}")


@query(f"{CLASSIFIED}, vb AS (SELECT brand, bucket, count(*) OVER w AS k, sum(abs(2 * buy - volume)) OVER w / sum(volume) OVER w AS vpin FROM cl WINDOW w AS (PARTITION BY brand ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT brand, bucket, round(vpin, 6) AS vpin FROM vb WHERE k = 20")
def mkt_vpin_buckets(spark, d):
    return vpin(spark, d).select("brand", "bucket", F.round("vpin", 6).alias("vpin"))


def vpin_daily(spark, d):
    """Population deviation of up to 20 returns, cdf split of each day's volume, ratio over 50 days."""
    w = by_brand()
    b = bars(spark, d).where("ret is not null").withColumn("sd", F.stddev_pop("ret").over(w.rowsBetween(-19, 0)))
    buy = F.col("volume") * S.normal_cdf(F.when(F.col("sd") > 1e-12, F.col("ret") / F.col("sd")).otherwise(0.0))
    b = b.withColumn("gap", F.abs(2 * buy - F.col("volume")))
    last = w.rowsBetween(-49, 0)
    return b.withColumn("k", F.count("*").over(last)).withColumn("vpin", F.sum("gap").over(last) / F.sum("volume").over(last)).where("k = 50")


VPIN = f"""vd0 AS (SELECT brand, bars.d, ret, volume, stddev_pop(ret) OVER (PARTITION BY brand ORDER BY bars.d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM bars WHERE ret IS NOT NULL), vd1 AS (SELECT brand, d, volume, CASE WHEN sd > 1e-12 THEN ret / sd ELSE 0.0 END AS x FROM vd0),
vd2 AS (SELECT brand, d, volume, abs(2 * volume * {normal_cdf_sql('x')} - volume) AS gap FROM vd1), vd3 AS (SELECT brand, vd2.d, count(*) OVER w AS k, sum(gap) OVER w / sum(volume) OVER w AS vpin FROM vd2 WINDOW w AS (PARTITION BY brand ORDER BY vd2.d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), vd AS (SELECT brand, d, vpin FROM vd3 WHERE k = 50)"""
FLAGS = f"{VPIN}, vf AS (SELECT brand, arg_max(vpin, d) AS vpin FROM vd GROUP BY 1)"


@query(f"WITH {VPIN} SELECT brand, CAST(d AS VARCHAR) AS dd, round(vpin, 6) AS vpin FROM vd")
def mkt_vpin_daily(spark, d):
    return vpin_daily(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.round("vpin", 6).alias("vpin"))


@query(f"WITH {FLAGS} SELECT brand, round(vpin, 6) AS vpin, vpin > 0.7 AS toxic, CASE WHEN vpin >= 0.5 THEN 'high' WHEN vpin >= 0.3 THEN 'elevated' ELSE 'normal' END AS regime FROM vf")
def mkt_vpin_flags(spark, d):
    last = vpin_daily(spark, d).groupBy("brand").agg(F.max_by("vpin", "d").alias("vpin"))
    return last.select("brand", F.round("vpin", 6).alias("vpin"), (F.col("vpin") > 0.7).alias("toxic"), S.ladder(F.col("vpin"), [(0.5, "high"), (0.3, "elevated")], "normal").alias("regime"))


LAMBDA = """lm AS (SELECT brand, bars.d, close - lag(close) OVER w AS dp, sign(coalesce(ret, 0)) * volume AS sv FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)),
ky AS (SELECT brand, lm.d, CASE WHEN count(dp) OVER o >= 20 THEN regr_slope(dp, sv) OVER o END AS lam FROM lm WINDOW o AS (PARTITION BY brand ORDER BY lm.d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


def kyle(spark, d):
    w = by_brand()
    x = bars(spark, d).withColumn("dp", F.col("close") - F.lag("close").over(w)).withColumn("sv", F.signum(F.coalesce("ret", F.lit(0.0))) * F.col("volume"))
    o = w.rowsBetween(-60, -1)
    return x.withColumn("lam", F.when(F.count("dp").over(o) >= 20, F.regr_slope("dp", "sv").over(o)))


@query(f"WITH {LAMBDA} SELECT brand, CAST(d AS VARCHAR) AS dd, round(lam, 5) AS lam FROM ky WHERE lam IS NOT NULL")
def mkt_kyle_lambda(spark, d):
    return kyle(spark, d).where("lam is not null").select("brand", F.col("d").cast("string").alias("dd"), F.round("lam", 5).alias("lam"))


@query(f"WITH {LAMBDA}, q AS (SELECT brand, quantile_cont(round(lam, 9), 0.33) AS lo, quantile_cont(round(lam, 9), 0.66) AS hi, arg_max(round(lam, 9), d) AS last FROM ky WHERE lam IS NOT NULL GROUP BY 1) SELECT brand, CASE WHEN last > hi THEN 'illiquid' WHEN last < lo THEN 'liquid' ELSE 'normal' END AS regime FROM q")
def mkt_lambda_regime(spark, d):
    k = kyle(spark, d).where("lam is not null").withColumn("lam", F.round("lam", 9))
    q = k.groupBy("brand").agg(F.percentile("lam", 0.33).alias("lo"), F.percentile("lam", 0.66).alias("hi"), F.max_by("lam", "d").alias("last"))
    return q.select("brand", F.when(F.col("last") > F.col("hi"), "illiquid").when(F.col("last") < F.col("lo"), "liquid").otherwise("normal").alias("regime"))


SNAP = """sn AS (SELECT brand, bars.d, close, count(*) OVER w AS n, stddev_pop(ret) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) AS vol20, (high - low) / close AS rng,
 (sign(coalesce(ret, 0)) * volume - avg(sign(coalesce(ret, 0)) * volume) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) / stddev_pop(sign(coalesce(ret, 0)) * volume) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS flow_z FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)),
sp AS (SELECT brand, round(arg_max(vol20, d), 5) AS vol20, round(arg_max(rng, d), 6) AS rng, round(arg_max(flow_z, d), 5) AS flow_z FROM sn WHERE n >= 30 GROUP BY 1)"""


def snapshots(spark, d):
    w = by_brand()
    sv = F.signum(F.coalesce("ret", F.lit(0.0))) * F.col("volume")
    q = w.rowsBetween(-59, 0)
    b = bars(spark, d).withColumn("sv", sv).withColumn("n", F.row_number().over(w)).withColumn("vol20", F.stddev_pop("ret").over(w.rowsBetween(-19, 0)) * math.sqrt(252)).withColumn("rng", (F.col("high") - F.col("low")) / F.col("close"))
    b = b.withColumn("flow_z", (F.col("sv") - F.avg("sv").over(q)) / F.stddev_pop("sv").over(q)).where("n >= 30")
    return b.groupBy("brand").agg(F.round(F.max_by("vol20", "d"), 5).alias("vol20"), F.round(F.max_by("rng", "d"), 6).alias("rng"), F.round(F.max_by("flow_z", "d"), 5).alias("flow_z"))


@query(f"WITH {SNAP} SELECT * FROM sp")
def mkt_micro_snapshot(spark, d):
    return snapshots(spark, d)


PANEL = f"""{SNAP}, ps AS (SELECT brand, arg_max(longs / oi, week) AS rank FROM positioning GROUP BY 1), pn AS (SELECT sp.*, round(rank, 6) AS rank, CASE WHEN rank >= 0.8 THEN 'crowded_long' WHEN rank <= 0.2 THEN 'crowded_short' WHEN rank >= 0.65 THEN 'approaching_long' WHEN rank <= 0.35 THEN 'approaching_short' ELSE 'neutral' END AS label FROM sp LEFT JOIN ps ON ps.brand = sp.brand)"""


def panel(spark, d):
    p = positioning(spark, d).groupBy("brand").agg(F.max_by(F.col("longs") / F.col("oi"), "week").alias("rank"))
    return snapshots(spark, d).join(p, "brand", "left").withColumn("label", S.positioning_label(F.col("rank"))).withColumn("rank", F.round("rank", 6))


@query(f"WITH {PANEL} SELECT * FROM pn")
def mkt_instrument_panel(spark, d):
    return panel(spark, d)


@query(f"""WITH {PANEL.removeprefix('WITH ')}, {STRESS}, lv AS (SELECT substr(instrument, 7) AS brand, avg_score, CASE WHEN avg_score IS NULL THEN 'NO_DATA' WHEN avg_score <= -0.2 THEN 'HIGH' WHEN avg_score <= -0.1 THEN 'MODERATE' WHEN avg_score <= 0 THEN 'LOW' ELSE 'STABLE' END AS level FROM st)
SELECT pn.*, avg_score, level, CASE WHEN abs(flow_z) > 2 THEN 3 WHEN abs(flow_z) > 1 THEN 1 ELSE 0 END + CASE WHEN label LIKE 'crowded%' THEN 3 WHEN label LIKE 'approaching%' THEN 1 ELSE 0 END + CASE level WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS priority FROM pn LEFT JOIN lv ON lv.brand = pn.brand""")
def mkt_commodity_probe(spark, d):
    s = stress(spark, d).select(F.expr("substring(instrument, 7)").alias("brand"), "avg_score", "level")
    x = panel(spark, d).join(s, "brand", "left")
    points = F.when(F.abs("flow_z") > 2, 3).when(F.abs("flow_z") > 1, 1).otherwise(0) + F.when(F.col("label").startswith("crowded"), 3).when(F.col("label").startswith("approaching"), 1).otherwise(0)
    points = points + F.when(F.col("level") == "HIGH", 3).when(F.col("level") == "MODERATE", 2).when(F.col("level") == "LOW", 1).otherwise(0)
    return x.withColumn("priority", points).orderBy(F.desc("priority"), "brand")


@query(f"""WITH q AS (SELECT p_brand, p_size % 5 AS expiry, 100.0::DOUBLE AS spot, CAST(80 + p_size AS DOUBLE) AS strike, (p_size % 5 + 1) / 12 AS t, p_retailprice / 5000 AS iv, p_size * 3 AS oi FROM part), x AS (SELECT *, (ln(spot / strike) + (0.02::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1, (ln(spot / strike) + (0.02::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) - iv * sqrt(t) AS d2 FROM q),
n AS (SELECT *, {normal_cdf_sql('d1')} AS n1, {normal_cdf_sql('d2')} AS n2 FROM x) SELECT p_brand, expiry, round(sum((spot * n1 - strike * exp(-0.02::DOUBLE * t) * n2) * oi), 2) AS value, round(sum(n1 * oi), 2) AS delta FROM n GROUP BY 1, 2""")
def mkt_option_exposure(spark, d):
    """Black-Scholes value and delta of a table of quotes times open interest, summed per underlying and size class."""
    from .views import table

    p = table(spark, d, "part")
    q = p.select("p_brand", (F.col("p_size") % 5).alias("expiry"), F.lit(100.0).alias("spot"), (80 + F.col("p_size")).cast("double").alias("strike"), ((F.col("p_size") % 5 + 1) / 12).alias("t"), (F.col("p_retailprice") / 5000).alias("iv"), (F.col("p_size") * 3).alias("oi"))
    sq = F.col("iv") * F.sqrt("t")
    d1 = (F.log(F.col("spot") / F.col("strike")) + (0.02 + F.col("iv") * F.col("iv") / 2) * F.col("t")) / sq
    q = q.withColumn("n1", S.normal_cdf(d1)).withColumn("n2", S.normal_cdf(d1 - sq))
    value = F.col("spot") * F.col("n1") - F.col("strike") * F.exp(-0.02 * F.col("t")) * F.col("n2")
    return q.groupBy("p_brand", "expiry").agg(F.round(F.sum(value * F.col("oi")), 2).alias("value"), F.round(F.sum(F.col("n1") * F.col("oi")), 2).alias("delta"))


@query("""WITH w AS (SELECT brand, d, ret, volume FROM bars WHERE ret IS NOT NULL AND d >= DATE '2000-01-01'), m AS (SELECT d, avg(ret) AS m FROM w GROUP BY 1), c AS (SELECT brand, corr(ret, m) AS c, avg(volume) AS liq FROM w JOIN m ON m.d = w.d GROUP BY 1)
SELECT brand, round(c, 5) AS corr, round(greatest(c, 0) / 25 / liq * 1000, 6) AS unwind FROM c""")
def mkt_crowding(spark, d):
    w = bars(spark, d).where("ret is not null and d >= date '2000-01-01'")
    m = w.groupBy("d").agg(F.avg("ret").alias("m"))
    c = w.join(m, "d").groupBy("brand").agg(F.corr("ret", "m").alias("c"), F.avg("volume").alias("liq"))
    return c.select("brand", F.round("c", 5).alias("corr"), F.round(F.greatest("c", F.lit(0.0)) / 25 / F.col("liq") * 1000, 6).alias("unwind"))


@query(f"""WITH {FLAGS}, {LAMBDA}, lq AS (SELECT brand, quantile_cont(round(lam, 9), 0.66) AS hi, arg_max(round(lam, 9), d) AS last FROM ky WHERE lam IS NOT NULL GROUP BY 1), cw AS (SELECT brand, d, ret FROM bars WHERE ret IS NOT NULL AND d >= DATE '2000-01-01'), cm AS (SELECT d, avg(ret) AS m FROM cw GROUP BY 1), cr AS (SELECT brand, corr(ret, m) AS c FROM cw JOIN cm ON cm.d = cw.d GROUP BY 1)
SELECT brand, 'vpin' AS flag FROM vf WHERE vpin > 0.7 UNION ALL SELECT brand, 'illiquid' FROM lq WHERE last > hi UNION ALL SELECT brand, 'crowding' FROM cr WHERE round(c, 5) > 0.2""")
def mkt_risk_scan(spark, d):
    toxic = mkt_vpin_flags(spark, d).where("toxic").select("brand", F.lit("vpin").alias("flag"))
    dry = mkt_lambda_regime(spark, d).where("regime = 'illiquid'").select("brand", F.lit("illiquid").alias("flag"))
    crowd = mkt_crowding(spark, d).where("corr > 0.2").select("brand", F.lit("crowding").alias("flag"))
    return toxic.unionByName(dry).unionByName(crowd)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY bars.d DESC) AS k FROM bars), o AS (SELECT brand, least(greatest(high / close, 0.0), 3.0) AS c, least(greatest(low / close, 0.0), 3.0) AS p, least(greatest(volume / 100, 0.0), 5.0) AS pc, least(ln(1 + trades), 20.0) AS oi, close FROM l WHERE k = 1)
SELECT p.brand, CASE WHEN o.brand IS NULL THEN 0.0 ELSE 1.0 END AS present, round(coalesce(c, 0), 6) AS call_iv, round(coalesce(o.p, 0), 6) AS put_iv, round(coalesce(pc, 0), 6) AS put_call, round(coalesce(oi, 0), 6) AS log_oi, round(coalesce(close, 0), 6) AS spot, round(coalesce(least(greatest(o.p - c, -2.0), 2.0), 0), 6) AS iv_spread FROM (SELECT DISTINCT p_brand AS brand FROM part) p LEFT JOIN o ON o.brand = p.brand""")
def mkt_option_block(spark, d):
    """Seven features of an instrument's latest chain; zeros where there is none. A bar stands for the chain."""
    from .views import table

    last = bars(spark, d).groupBy("brand").agg(F.max_by(F.struct("close", "high", "low", "volume", "trades"), "d").alias("x"))
    held = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    call, put = held(F.col("x.high") / F.col("x.close"), 0.0, 3.0), held(F.col("x.low") / F.col("x.close"), 0.0, 3.0)
    features = {"call_iv": call, "put_iv": put, "put_call": held(F.col("x.volume") / 100, 0.0, 5.0), "log_oi": F.least(F.log1p("x.trades"), F.lit(20.0)), "spot": F.col("x.close"), "iv_spread": held(put - call, -2.0, 2.0)}
    every = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct().join(last, "brand", "left")
    return every.select("brand", F.when(F.col("x").isNull(), 0.0).otherwise(1.0).alias("present"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in features.items()])


@query("""WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, avg(CASE WHEN l_linenumber <= 2 THEN l_tax END) * 100 AS y3m, avg(CASE WHEN l_linenumber BETWEEN 3 AND 4 THEN l_tax END) * 100 AS y2, avg(CASE WHEN l_linenumber >= 5 THEN l_tax END) * 100 AS y10 FROM lineitem GROUP BY 1)
SELECT concat('', mth) AS mth, 1.0 AS present, round(least(greatest(y2, 0), 20), 6) AS yield_2y, round(least(greatest(y10, 0), 20), 6) AS yield_10y, round(least(greatest(y10 - y2, -5), 5), 6) AS curve_2s10s, round(least(greatest(y10 - y3m, -5), 5), 6) AS curve_3m10y FROM m WHERE y2 IS NOT NULL AND y10 IS NOT NULL AND y3m IS NOT NULL""")
def mkt_rate_block(spark, d):
    """Five features of the yield curve of each month, shared by all instruments. Taxes by line number stand for the tenors."""
    from .views import table

    n = F.col("l_linenumber")
    y = {"y3m": n <= 2, "y2": n.between(3, 4), "y10": n >= 5}
    m = table(spark, d, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("mth")).agg(*[(F.avg(F.when(when, F.col("l_tax"))) * 100).alias(c) for c, when in y.items()]).dropna()
    held = lambda c, low, high: F.round(F.least(F.greatest(c, F.lit(low)), F.lit(high)), 6)
    y2, y10 = F.col("y2"), F.col("y10")
    return m.select(F.col("mth").cast("string").alias("mth"), F.lit(1.0).alias("present"), held(y2, 0.0, 20.0).alias("yield_2y"), held(y10, 0.0, 20.0).alias("yield_10y"), held(y10 - y2, -5.0, 5.0).alias("curve_2s10s"), held(y10 - F.col("y3m"), -5.0, 5.0).alias("curve_3m10y"))


@query("""WITH v AS (SELECT c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 5000 AS amount, max(c_acctbal) AS spot FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN amount IS NULL THEN 0.0 ELSE 1.0 END AS present, round(coalesce(least(greatest(amount, 0), 100), 0), 6) AS amount, round(CASE WHEN amount > 0 AND spot > 1e-6 THEN least(greatest(least(amount, 100) * 4 / spot, 0), 0.5) ELSE 0 END, 6) AS yield_proxy FROM v""")
def mkt_dividend_block(spark, d):
    """Three features of the latest dividend of an entity: zeros where there is none."""
    from .views import table

    # greatest and least pass over nulls, so an entity without an amount is told before them
    paid = table(spark, d, "orders").where("o_totalprice is not null")
    last = paid.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("x"))
    amount = F.when(F.col("x").isNotNull(), F.least(F.greatest(F.col("x") / 5000, F.lit(0.0)), F.lit(100.0)))
    v = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("amount", amount)
    proxy = F.when((F.col("amount") > 0) & (F.col("c_acctbal") > 1e-6), F.least(F.col("amount") * 4 / F.col("c_acctbal"), F.lit(0.5))).otherwise(0.0)
    return v.select("c_custkey", F.when(F.col("amount").isNull(), 0.0).otherwise(1.0).alias("present"), F.round(F.coalesce("amount", F.lit(0.0)), 6).alias("amount"), F.round(proxy, 6).alias("yield_proxy"))
