"""Change, drift, dependence and portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import topology
from ..operators.joins import interval_join
from ..operators.stats import weighted_quantile
from ..registry import query
from ..session import written
from .joining import WIDE, linked, wide
from .ranking import diversified
from .series import event_scores
from .views import bars, country_events, links, obs, series, table


@query()
def drf_bocpd(spark, d):
    s = series(spark, d)
    out = D.change_points(s, "signal", "d", "value")
    return out.select(F.col("key").alias("signal"), F.col("o").cast("string").alias("d"), "run_length", "change")


@query()
def drf_bocpd_changepoints(spark, d):
    return drf_bocpd(spark, d).where("change").groupBy("signal").agg(F.count("*").alias("changes"), F.max("d").alias("latest"))


@query()
def drf_anomaly_digest(spark, d):
    """Large scores with the change-point flag of their source's daily series, diversified."""
    z = event_scores(spark, d).select("obs_id", "entity_id", "source", "ts", F.abs(F.round("z", 6)).alias("z")).where("z >= 1.5")
    daily = obs(spark, d).groupBy("source", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    change = D.change_points(daily, "source", "day", "v", hazard=30.0, least=3.0).where("change").select(F.col("key").alias("source")).distinct().withColumn("changed", F.lit(1))
    j = z.join(change, "source", "left").withColumn("rank", F.coalesce("changed", F.lit(0)) * 1000 + F.col("z"))
    return diversified(j, ["source", "entity_id"], "rank", "obs_id", 40).select("obs_id", "entity_id", "source", "z", F.coalesce("changed", F.lit(0)).alias("changed"))


@query("""WITH x AS (SELECT brand, bars.d, count(*) OVER w AS n, avg(ret) OVER w / greatest(stddev_pop(ret) OVER w, 1e-8) * sqrt(52) AS s FROM bars WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY brand ORDER BY bars.d ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
g AS (SELECT brand, arg_max(s, d) AS last, max(s) AS peak FROM x WHERE n = 52 GROUP BY 1) SELECT brand, round(last, 5) AS last, round(greatest(0, least(1, (peak - last) / greatest(abs(peak), 1e-9))), 5) AS decay, greatest(0, least(1, (peak - last) / greatest(abs(peak), 1e-9))) >= 0.5 AS decayed FROM g""")
def drf_edge_decay(spark, d):
    """Last rolling Sharpe against its running peak; decayed when it has lost half."""
    o = Window.partitionBy("brand").orderBy("d")
    s = bars(spark, d).where("ret is not null").withColumn("n", F.count("*").over(o.rowsBetween(-51, 0))).withColumn("s", F.avg("ret").over(o.rowsBetween(-51, 0)) / F.greatest(F.stddev_pop("ret").over(o.rowsBetween(-51, 0)), F.lit(1e-8)) * 52**0.5).where("n = 52")
    g = s.groupBy("brand").agg(F.max_by("s", "d").alias("last"), F.max("s").alias("peak"))
    drop = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("peak") - F.col("last")) / F.greatest(F.abs("peak"), F.lit(1e-9))))
    return g.select("brand", F.round("last", 5).alias("last"), F.round(drop, 5).alias("decay"), (drop >= 0.5).alias("decayed"))


DRIFT_DAYS = """e AS (SELECT entity_id AS source, CAST(ts AS DATE) AS day, count(*) AS n, avg(score) AS v FROM country_events GROUP BY 1, 2), dl AS (SELECT source, day, CAST(n AS DOUBLE) AS n, tanh(v / (abs(v) + 1)) AS m, day > max(day) OVER () - 30 AS recent, day > max(day) OVER () - 365 AS kept FROM e)"""


@query(f"""WITH {DRIFT_DAYS}, x AS (SELECT source, 'n' AS c, n AS x, recent FROM dl WHERE kept UNION ALL SELECT source, 'm', m, recent FROM dl WHERE kept),
k AS (SELECT source, c, x, count(*) FILTER (WHERE recent) AS a, count(*) AS b FROM x GROUP BY 1, 2, 3),
f AS (SELECT source, c, sum(a) OVER w / sum(a) OVER (PARTITION BY source, c) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY source, c) AS fb, lead(x) OVER w - x AS gap FROM k WINDOW w AS (PARTITION BY source, c ORDER BY x)),
w1 AS (SELECT source, c, coalesce(sum(abs(fa - fb) * gap), 0) AS w1 FROM f GROUP BY 1, 2), sd AS (SELECT source, c, stddev_samp(x) AS sd, count(*) FILTER (WHERE recent) AS short FROM x GROUP BY 1, 2),
r AS (SELECT w1.source, avg(CASE WHEN sd > 1e-10 THEN w1 / sd ELSE w1 * 10 END) AS drift FROM w1 JOIN sd ON w1.source = sd.source AND w1.c = sd.c WHERE short > 0 GROUP BY 1) SELECT source, round(drift, 5) AS drift, round(drift, 5) > 1 AS alarm FROM r""")
def drf_wasserstein_drift(spark, d):
    """Daily count and bounded mean score of each country: the last 30 days against the last 365, by W1 over the baseline's deviation."""
    e = country_events(spark, d).groupBy(F.col("entity_id").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"), F.avg("score").alias("v"))
    e = written(e, "daily")
    last = F.broadcast(e.agg(F.max("day").alias("last")))  # one row
    kept = e.join(last).where(F.col("day") > F.date_sub("last", 365)).withColumn("recent", F.col("day") > F.date_sub("last", 30))
    both = F.explode(F.array(F.struct(F.lit("n").alias("c"), F.col("n").alias("x")), F.struct(F.lit("m").alias("c"), F.tanh(F.col("v") / (F.abs("v") + 1)).alias("x")))).alias("p")
    x = written(kept.select("source", "recent", both).select("source", "recent", "p.c", "p.x"), "values")
    w = D.sample_distances(x, ["source", "c"], "x", F.col("recent"), F.lit(True))
    sd = x.groupBy("source", "c").agg(F.stddev_samp("x").alias("sd"))
    each = w.join(sd, ["source", "c"]).select("source", F.when(F.col("sd") > 1e-10, F.col("w1") / F.col("sd")).otherwise(F.col("w1") * 10).alias("drift"))
    g = each.groupBy("source").agg(F.round(F.avg("drift"), 5).alias("drift"))
    return g.select("source", "drift", (F.col("drift") > 1).alias("alarm"))


TAU = """jb AS (SELECT a.brand AS ba, b.brand AS bb, a.m, a.x, b.x AS y FROM mb a JOIN mb b ON a.m = b.m AND a.brand < b.brand)"""


@query("""WITH mb AS (SELECT brand, date_trunc('month', d)::DATE AS m, round(sum(volume), 6) AS x FROM bars GROUP BY 1, 2), """ + TAU + """,
p AS (SELECT u.ba, u.bb, sign(u.x - v.x) AS sx, sign(u.y - v.y) AS sy FROM jb u JOIN jb v ON u.ba = v.ba AND u.bb = v.bb AND u.m < v.m), t AS (SELECT ba, bb, sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))) AS tau FROM p GROUP BY 1, 2)
SELECT ba, bb, round(tau, 6) AS tau, round(CASE WHEN tau > 0 THEN pow(2, -1 / (2 * tau / (1 - tau))) ELSE 0 END, 6) AS clayton, round(CASE WHEN tau > 0 THEN 2 - pow(2, 1 - tau) ELSE 0 END, 6) AS gumbel FROM t""")
def drf_tail_dependence(spark, d):
    """Kendall's tau-b on monthly bins and the tail coefficients that follow from it. The bins bound the pairs."""
    mb = bars(spark, d).groupBy("brand", F.to_date(F.trunc("d", "month")).alias("m")).agg(F.round(F.sum("volume"), 6).alias("x"))
    j = mb.toDF("ba", "m", "x").join(mb.toDF("bb", "m", "y"), "m").where("ba < bb")
    g = j.groupBy("ba", "bb").agg(F.sort_array(F.collect_list(F.struct("m", "x", "y"))).alias("xs"))
    pairs = g.select("ba", "bb", F.explode(F.expr("flatten(transform(xs, (u, i) -> transform(slice(xs, i + 2, size(xs)), v -> struct(signum(u.x - v.x) as sx, signum(u.y - v.y) as sy))))")).alias("p"))
    t = pairs.groupBy("ba", "bb").agg((F.sum(F.col("p.sx") * F.col("p.sy")) / F.sqrt(F.sum(F.abs("p.sx")) * F.sum(F.abs("p.sy")))).alias("tau"))
    up = F.col("tau") > 0
    theta = 2 * F.col("tau") / (1 - F.col("tau"))
    return t.select("ba", "bb", F.round("tau", 6).alias("tau"), F.round(F.when(up, F.pow(F.lit(2.0), -1 / theta)).otherwise(0.0), 6).alias("clayton"), F.round(F.when(up, 2 - F.pow(F.lit(2.0), 1 - F.col("tau"))).otherwise(0.0), 6).alias("gumbel"))


def quarter_distances(spark, d):
    """Correlation distances between brands, a window a quarter."""
    r = bars(spark, d).where("ret is not null").select(F.to_date(F.trunc("d", "quarter")).cast("string").alias("g"), "d", F.col("brand").alias("point"), "ret")
    return written(topology.correlation_distances(written(r, "returns")), "distances")


@query()
def drf_regime_topology(spark, d):
    """Per quarter: components at the median merge, persistence entropy, and the distance of its diagram to that of the first quarter, the baseline."""
    diagrams = written(topology.persistence(quarter_distances(spark, d)), "diagrams")
    base = F.broadcast(diagrams.orderBy("g").limit(1).select(F.col("deaths").alias("base")))  # one row
    deaths = F.col("deaths")
    median = F.when(F.size(deaths) > 0, (deaths[F.expr("int((size(deaths) - 1) / 2)")] + deaths[F.expr("int(size(deaths) / 2)")]) / 2)
    apart = F.size(F.filter(deaths, lambda x: x > F.col("median")))
    out = diagrams.join(base).withColumn("median", median)
    return out.select(F.col("g").alias("q"), (apart + 1).cast("long").alias("components"), F.round(topology.entropy(deaths), 6).alias("entropy"), F.round(topology.matching_distance(deaths, F.col("base")), 6).alias("distance"))


@query()
def drf_spectral_gap(spark, d):
    """Per quarter: how strongly the graph of brands nearer than the quarter's median distance holds together."""
    return topology.spectral_gap(quarter_distances(spark, d)).select(F.col("g").alias("q"), F.round("gap", 5).alias("gap"))


@query("""WITH r AS (SELECT brand, ln(close) AS x, row_number() OVER (PARTITION BY brand ORDER BY bars.d) AS n FROM bars), l AS (SELECT a.brand, k, avg(pow(b.x - a.x, 2)) AS v FROM r a, range(1, 21) t(k) JOIN r b ON b.brand = a.brand AND b.n = a.n + k GROUP BY 1, 2)
SELECT brand, round(least(0.99, greatest(0.01, regr_slope(ln(v), ln(k)) / 2)), 5) AS hurst FROM l GROUP BY 1""")
def drf_hurst(spark, d):
    """Half the slope of the log mean squared increment on the log lag; the lags come from one ordered window."""
    w = Window.partitionBy("brand").orderBy("d")
    x = bars(spark, d).withColumn("x", F.log("close"))
    inc = x.select("brand", *[F.pow(F.lead("x", k).over(w) - F.col("x"), 2).alias(f"i{k}") for k in range(1, 21)])
    v = inc.groupBy("brand").agg(*[F.avg(f"i{k}").alias(f"v{k}") for k in range(1, 21)])
    long = v.select("brand", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")) for k in range(1, 21)])).alias("p"))
    h = F.regr_slope(F.log("p.v"), F.log("p.k")) / 2
    return long.groupBy("brand").agg(F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), h)), 5).alias("hurst"))


@query()
def drf_power_spectrum(spark, d):
    def run(key: str, x: np.ndarray) -> pd.DataFrame:
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
        return pd.DataFrame({"signal": key, "frequency": np.arange(len(p)), "power": np.round(p, 6)})

    return D.per_series(series(spark, d), "signal", "d", "value", "signal string, frequency long, power double", run)


@query()
def drf_scalogram(spark, d):
    def run(key: str, x: np.ndarray) -> pd.DataFrame:
        out = []
        for period in (5, 10, 21, 63):
            t = np.arange(-3 * period, 3 * period + 1)
            wave = np.exp(2j * np.pi * t / period) * np.exp(-0.5 * (t / period) ** 2) / np.sqrt(period)
            out.append(float((np.abs(np.convolve(x - x.mean(), wave, "same")) ** 2).mean()))
        return pd.DataFrame({"signal": key, "period": [5, 10, 21, 63], "power": np.round(out, 6)})

    return D.per_series(series(spark, d), "signal", "d", "value", "signal string, period long, power double", run)


@query()
def drf_hmm_regimes(spark, d):
    weekly = bars(spark, d).where("ret is not null").groupBy("brand", F.to_date(F.date_trunc("week", "d")).alias("w")).agg(F.sum("ret").alias("r"))

    def run(key: str, x: np.ndarray) -> pd.DataFrame:
        lab = D.hmm_labels(x)
        return pd.DataFrame({"brand": [key], "weeks": [len(x)], "high": [int((lab == 1).sum())], "switches": [int((np.diff(lab) != 0).sum())]})

    return D.per_series(weekly, "brand", "w", "r", "brand string, weeks long, high long, switches long", run)


@query("""WITH b AS (SELECT source, least(floor(value / 10), 9) AS x, event_id FROM (SELECT source, value, obs_id AS event_id FROM obs)), n AS (SELECT count(*) AS n FROM b), j AS (SELECT source, x, count(*) AS c FROM b GROUP BY 1, 2), a AS (SELECT source, sum(c) AS c FROM j GROUP BY 1), e AS (SELECT x, sum(c) AS c FROM j GROUP BY 1)
SELECT round(sum(j.c / n.n * ln(j.c * n.n / (a.c * e.c))), 8) AS mi FROM j JOIN a ON a.source = j.source JOIN e ON e.x = j.x, n""")
def drf_mutual_information(spark, d):
    j = obs(spark, d).groupBy("source", F.least(F.floor(F.col("value") / 10), F.lit(9)).alias("x")).agg(F.count("*").cast("double").alias("c"))
    a = F.sum("c").over(Window.partitionBy("source"))
    e = F.sum("c").over(Window.partitionBy("x"))
    n = F.broadcast(j.agg(F.sum("c").alias("n")))  # one row
    return j.withColumn("a", a).withColumn("e", e).join(n).agg(F.round(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("e")))), 8).alias("mi"))


@query("""WITH p AS (SELECT a.source AS sa, b.source AS sb, count(*) AS c FROM obs a JOIN obs b ON a.entity_id = b.entity_id AND a.source < b.source AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000 GROUP BY 1, 2), t AS (SELECT sum(c) AS t FROM p), s AS (SELECT s, sum(c) AS c FROM (SELECT sa AS s, c FROM p UNION ALL SELECT sb, c FROM p) GROUP BY 1)
SELECT sa, sb, p.c AS n, round(ln(p.c / t / ((x.c / (2 * t)) * (y.c / (2 * t)))), 6) AS pmi FROM p JOIN s x ON x.s = sa JOIN s y ON y.s = sb, t WHERE p.c >= 10""")
def drf_pmi_relationships(spark, d):
    o = obs(spark, d).select("entity_id", "source", "ts")
    p = interval_join(o, o, 86_400, ["entity_id"]).where("l.source < r.source").groupBy(F.col("l.source").alias("sa"), F.col("r.source").alias("sb")).agg(F.count("*").alias("n"))
    s = p.select(F.col("sa").alias("s"), "n").union(p.select("sb", "n")).groupBy("s").agg(F.sum("n").alias("c"))
    t = F.broadcast(p.agg(F.sum("n").alias("t")))  # one row
    j = p.join(s.toDF("sa", "ca"), "sa").join(s.toDF("sb", "cb"), "sb").join(t).where("n >= 10")
    return j.select("sa", "sb", "n", F.round(F.log(F.col("n") / F.col("t") / (F.col("ca") / (2 * F.col("t")) * (F.col("cb") / (2 * F.col("t"))))), 6).alias("pmi"))


@query("""WITH l AS (SELECT a.brand, a.d, min(b.d) AS nd FROM bars a JOIN bars b ON b.brand = a.brand AND b.d > a.d WHERE a.trades >= 3 AND b.volume >= 60 GROUP BY 1, 2) SELECT brand, count(*) AS n, round(avg(nd - d), 5) AS mean, round(stddev_samp(nd - d), 5) AS sd, round(quantile_cont(nd - d, 0.25), 5) AS p25, round(quantile_cont(nd - d, 0.75), 5) AS p75 FROM l GROUP BY 1""")
def drf_lag_distribution(spark, d):
    from .joining import join_lag_pairs

    lag = F.date_diff(F.col("next").cast("date"), F.col("d").cast("date"))
    x = join_lag_pairs(spark, d).withColumn("lag", lag)
    return x.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.avg("lag"), 5).alias("mean"), F.round(F.stddev_samp("lag"), 5).alias("sd"), F.round(F.percentile("lag", 0.25), 5).alias("p25"), F.round(F.percentile("lag", 0.75), 5).alias("p75"))


@query("""WITH e AS (SELECT entity_id, ts, quad FROM country_events) SELECT a.quad AS src, b.quad AS dst, count(*) AS n FROM e a JOIN e b ON a.entity_id = b.entity_id AND epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) - epoch_us(a.ts) <= 172800000000 GROUP BY 1, 2""")
def drf_co_occurrence_table(spark, d):
    # events of one time and class have the same partners: they are counted before they are paired
    e = country_events(spark, d).groupBy("entity_id", "ts", "quad").agg(F.count("*").alias("n"))
    p = interval_join(e, e, 172_800, ["entity_id"], low=0.0).where("delta > 0")  # l is the later one
    return p.groupBy(F.col("r.quad").alias("src"), F.col("l.quad").alias("dst")).agg(F.sum(F.col("l.n") * F.col("r.n")).alias("n"))


@query("""WITH w AS (SELECT brand, d, trades >= 3 AS a, lead(volume) OVER (PARTITION BY brand ORDER BY bars.d) >= 60 AS b FROM bars), t AS (SELECT brand, count(*) FILTER (WHERE a AND b) AS ab, count(*) FILTER (WHERE a AND NOT b) AS an, count(*) FILTER (WHERE NOT a AND b) AS nb, count(*) FILTER (WHERE NOT a AND NOT b) AS nn FROM w WHERE b IS NOT NULL GROUP BY 1)
SELECT brand, ab, round(ab / (ab + an), 6) AS hit, round((ab + nb) / (ab + an + nb + nn), 6) AS base, round((ab / (ab + an)) / ((ab + nb) / (ab + an + nb + nn)), 5) AS lift FROM t WHERE ab + an > 0 AND ab + nb > 0""")
def drf_pattern_validation(spark, d):
    nxt = F.lead("volume").over(Window.partitionBy("brand").orderBy("d")) >= 60
    w = bars(spark, d).select("brand", (F.col("trades") >= 3).alias("a"), nxt.alias("b")).where("b is not null")
    both, first, second = F.count_if(F.col("a") & F.col("b")), F.count_if("a"), F.count_if("b")
    t = w.groupBy("brand").agg(both.alias("ab"), first.alias("na"), second.alias("nb"), F.count("*").alias("n")).where("na > 0 and nb > 0")
    hit, base = F.col("ab") / F.col("na"), F.col("nb") / F.col("n")
    return t.select("brand", "ab", F.round(hit, 6).alias("hit"), F.round(base, 6).alias("base"), F.round(hit / base, 5).alias("lift"))


@query("""WITH m AS (SELECT brand, date_trunc('month', d)::DATE AS m, avg(close) AS p FROM bars WHERE close > 0 GROUP BY 1, 2), g AS (SELECT brand, CAST(t AS DATE) AS m FROM (SELECT DISTINCT brand FROM bars), generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-11-01', INTERVAL 1 MONTH) x(t)), j AS (SELECT g.brand, g.m, p FROM g LEFT JOIN m ON m.brand = g.brand AND m.m = g.m)
SELECT brand, CAST(m AS VARCHAR) AS mm, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY brand ORDER BY j.m), first_value(p IGNORE NULLS) OVER (PARTITION BY brand ORDER BY j.m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS price FROM j""")
def pfl_price_bins(spark, d):
    return price_bins(spark, d).select("brand", F.col("m").cast("string").alias("mm"), F.round("price", 6).alias("price"))


def price_bins(spark, d):
    m = bars(spark, d).where("close > 0").groupBy("brand", F.to_date(F.trunc("d", "month")).alias("m")).agg(F.avg("close").alias("p"))
    grid = m.select("brand").distinct().withColumn("m", F.explode(F.expr("sequence(date '1995-01-01', date '2001-11-01', interval 1 month)")))
    w = Window.partitionBy("brand").orderBy("m")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = grid.join(m, ["brand", "m"], "left")
    return j.withColumn("price", F.coalesce(F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("p", ignorenulls=True).over(whole)))


COV = """rr AS (SELECT brand, d, ret FROM bars WHERE ret IS NOT NULL), cv AS (SELECT a.brand AS a, b.brand AS b, covar_samp(a.ret, b.ret) AS c FROM rr a JOIN rr b ON a.d = b.d GROUP BY 1, 2), mv AS (SELECT avg(c) AS m FROM cv WHERE a = b)"""


def covariance(spark, d):
    r = bars(spark, d).where("ret is not null").select("brand", "d", "ret")
    return r.toDF("a", "d", "x").join(r.toDF("b", "d", "y"), "d").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))


@query(f"WITH {COV} SELECT a, b, round(0.95 * c + CASE WHEN a = b THEN 0.05 * m ELSE 0 END, 7) AS c FROM cv, mv")
def pfl_shrunk_covariance(spark, d):
    return shrunk(spark, d).withColumn("c", F.round("c", 7))


def shrunk(spark, d):
    cv = covariance(spark, d)
    m = F.broadcast(cv.where("a = b").agg(F.avg("c").alias("m")))  # one row
    return cv.join(m).select("a", "b", (0.95 * F.col("c") + F.when(F.col("a") == F.col("b"), 0.05 * F.col("m")).otherwise(0.0)).alias("c"))


def solve(spark, d, f):
    """f(covariance) for each portfolio, the brands of one maker: the small dense algebra of one portfolio in one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="a", columns="b", values="c").fillna(0.0)
        m = m.reindex(index=sorted(m.index), columns=sorted(m.index)).fillna(0.0)
        w = f(m.to_numpy())
        return pd.DataFrame({"brand": m.index, "weight": np.round(w, 6)})

    maker = lambda c: F.substring(c, 1, 7)
    return shrunk(spark, d).where(maker("a") == maker("b")).groupBy(maker("a")).applyInPandas(run, "brand string, weight double")


@query()
def pfl_black_litterman(spark, d):
    def f(s: np.ndarray) -> np.ndarray:
        k, tau, conf = len(s), 0.05, 0.6
        prior = 2.5 * s @ np.full(k, 1 / k)
        view = np.linspace(-0.01, 0.01, k)
        omega = np.diag((1 / conf - 1) * tau * np.diag(s) + 1e-12)
        inv = np.linalg.inv(tau * s)
        mu = np.linalg.solve(inv + np.linalg.inv(omega), inv @ prior + np.linalg.inv(omega) @ view)
        w = np.clip(1 / k * (1 + 0.5 * np.tanh(mu / np.sqrt(np.diag(s)))), 0, None)
        return w / w.sum()

    return solve(spark, d, f)


@query()
def pfl_hrp(spark, d):
    """Recursive bisection by position, risk shared by inverse cluster variance."""

    def f(s: np.ndarray) -> np.ndarray:
        order = list(np.argsort(-np.diag(s), kind="stable"))
        w = np.ones(len(s))

        def variance(ix: list[int]) -> float:
            inv = 1 / np.diag(s)[ix]
            p = inv / inv.sum()
            return float(p @ s[np.ix_(ix, ix)] @ p)

        parts = [order]
        while parts:
            ix = parts.pop()
            if len(ix) > 1:
                a, b = ix[: len(ix) // 2], ix[len(ix) // 2 :]
                share = 1 - variance(a) / (variance(a) + variance(b))
                w[a] *= share
                w[b] *= 1 - share
                parts += [a, b]
        return w / w.sum()

    return solve(spark, d, f)


@query()
def pfl_robust_weights(spark, d):
    def f(s: np.ndarray) -> np.ndarray:
        """Long-only minimum variance under an inflated covariance, by gradient steps projected onto the simplex."""
        k = len(s)
        a = s + 0.1 * np.trace(s) / k * np.eye(k)
        w = np.full(k, 1 / k)
        rate = 0.5 / np.linalg.norm(a, 2)
        for _ in range(1000):
            v = w - rate * (a @ w)
            high = np.sort(v)[::-1]
            level = (np.cumsum(high) - 1) / np.arange(1, k + 1)  # the shift at which the largest i weights sum to one
            w = np.clip(v - level[np.flatnonzero(high > level)[-1]], 0, None)
        return w

    return solve(spark, d, f)


@query("""WITH z AS (SELECT brand, abs((arg_max(close, d) - avg(close)) / stddev_samp(close)) AS z FROM bars GROUP BY 1), k AS (SELECT * FROM z WHERE z >= 0.5) SELECT brand, round(1.0 / count(*) OVER (), 6) AS weight FROM k""")
def pfl_surprise_weights(spark, d):
    z = F.abs((F.max_by("close", "d") - F.avg("close")) / F.stddev_samp("close"))
    k = bars(spark, d).groupBy("brand").agg(z.alias("z")).where("z >= 0.5")
    n = F.broadcast(k.agg(F.count("*").alias("n")))  # one row
    return k.join(n).select("brand", F.round(1.0 / F.col("n"), 6).alias("weight"))


@query()
def pfl_portfolio_weights(spark, d):
    """The robust weights blended with the equal ones by a turnover limit, renormalised."""
    n = F.count("*").over(Window.partitionBy(F.substring("brand", 1, 7)))
    return pfl_robust_weights(spark, d).select("brand", F.round(0.7 * F.col("weight") + 0.3 / n, 6).alias("weight"))


@query(f"""WITH {WIDE}, j AS (SELECT o.source AS src, e.quad AS dst, round(epoch(e.ts) - epoch(o.ts), 3) AS lag FROM wide o JOIN links k ON k.entity_a = o.entity_id AND k.link_type = 'headquartered_in' JOIN country_events e ON e.entity_id = k.entity_b WHERE epoch(e.ts) - epoch(o.ts) BETWEEN 0 AND 604800),
g AS (SELECT src, dst, count(*) AS n, quantile_cont(lag, 0.75) AS p75, avg(lag) AS mean FROM j GROUP BY 1, 2), w AS (SELECT *, least(604800.0, greatest(3600.0, CASE WHEN p75 > 0 THEN p75 WHEN mean > 0 THEN 2 * mean ELSE 86400.0 END)) AS win FROM g),
c AS (SELECT j.src, j.dst, any_value(win) AS win, any_value(n) AS n, count(*) AS hits FROM j JOIN w ON w.src = j.src AND w.dst = j.dst WHERE lag <= win GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY hits DESC, dst) AS k, (hits - n * win / 604800) / sqrt(n * win / 604800) AS z FROM c)
SELECT src, dst, round(win, 2) AS win_s, hits, abs(z) >= 1.96 AS significant FROM r WHERE k = 1""")
def drf_lead_lag_rules(spark, d):
    """Of each source the event class that follows on the linked country most often, within a window from the lags themselves:
    their third quartile, or twice their mean, between an hour and a week; significant if more or fewer follow than evenly spread lags would."""
    week = 604_800.0
    # rows of one time and class have the same lags: they are counted before they are paired
    a = written(linked(wide(spark, d), links(spark, d), "headquartered_in").groupBy("entity_b", "ts", "source").agg(F.count("*").alias("n")), "observed")
    e = written(country_events(spark, d).withColumnRenamed("entity_id", "entity_b").groupBy("entity_b", "ts", "quad").agg(F.count("*").alias("n")), "happened")
    j = interval_join(e, a, week, ["entity_b"], low=0.0).select(F.col("r.source").alias("src"), F.col("l.quad").alias("dst"), F.round("delta", 3).alias("lag"), (F.col("l.n") * F.col("r.n")).alias("c"))
    g = weighted_quantile(j, ["src", "dst"], "lag", "c", 0.75).withColumnRenamed("quantile", "p75")
    own = F.when(F.col("p75") > 0, F.col("p75")).when(F.col("mean") > 0, 2 * F.col("mean")).otherwise(86_400.0)
    w = F.broadcast(g.withColumn("win", F.least(F.lit(week), F.greatest(F.lit(3_600.0), own))))  # a row for each source and class
    c = j.join(w, ["src", "dst"]).where("lag <= win").groupBy("src", "dst").agg(F.first("win").alias("win"), F.first("n").alias("n"), F.sum("c").alias("hits"))
    even = F.col("n") * F.col("win") / week
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("hits"), "dst"))).where("k = 1")
    return r.select("src", "dst", F.round("win", 2).alias("win_s"), "hits", (F.abs((F.col("hits") - even) / F.sqrt(even)) >= 1.96).alias("significant"))
