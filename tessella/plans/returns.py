"""Labels, scores, walk-forward folds and portfolio checks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.stats import average_rank
from ..registry import query
from .joining import join_asof_nearest, nearest
from .views import bars, positioning


def w_brand():
    return Window.partitionBy("brand").orderBy("d")


LABELS = """lt AS (SELECT brand, d, close, CAST(d + INTERVAL 29 DAY AS DATE) AS target FROM bars),
lc AS (SELECT t.brand, t.d, t.close, b.d AS fd, b.close AS fc, row_number() OVER (PARTITION BY t.brand, t.d ORDER BY abs(b.d - t.target), b.d) AS k FROM lt t JOIN bars b ON b.brand = t.brand AND abs(b.d - t.target) < 3),
lb AS (SELECT brand, d, fd, (fc - close) / abs(close) AS y FROM lc WHERE k = 1)"""


def labels(spark, d):
    b = bars(spark, d).select("brand", "d", "close")
    out = nearest(b.withColumn("target", F.date_add("d", 29)), b.select("brand", F.col("d").alias("fd"), F.col("close").alias("fc")), ["brand"], "target", "fd", "fc")
    ok = (F.abs(F.date_diff("near.ts", "target")) < 3) & (F.col("near.ts") != F.col("d"))
    return out.where(ok).select("brand", "d", F.col("near.ts").alias("fd"), ((F.col("near.value") - F.col("close")) / F.abs("close")).alias("y"))


@query(f"WITH {LABELS} SELECT brand, CAST(d AS VARCHAR) AS d, CAST(fd AS VARCHAR) AS future, round(y, 6) AS label FROM lb")
def btx_forward_return_labels(spark, d):
    return join_asof_nearest(spark, d)


@query(f"WITH {LABELS} SELECT brand, round(y, 6) AS y FROM lb WHERE d = DATE '1998-03-02'")
def btx_labels_for_date(spark, d):
    return labels(spark, d).where("d = date '1998-03-02'").select("brand", F.round("y", 6).alias("y"))


@query("SELECT brand, CAST(d AS VARCHAR) AS dd, round(CASE WHEN count(ret) OVER w >= 7 THEN sum(ret) OVER w END, 4) AS y FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d RANGE BETWEEN CURRENT ROW AND INTERVAL 29 DAY FOLLOWING)")
def btx_sum_log_return(spark, d):
    b = bars(spark, d).withColumn("n", F.unix_date("d").cast("long"))
    w = Window.partitionBy("brand").orderBy("n").rangeBetween(0, 29)
    return b.select("brand", F.col("d").cast("string").alias("dd"), F.round(F.when(F.count("ret").over(w) >= 7, F.sum("ret").over(w)), 4).alias("y"))


@query(f"WITH {LABELS} SELECT brand, count(*) AS n, round(avg(y), 5) AS mean, round(stddev_pop(y), 5) AS sd, round(min(y), 6) AS lo, round(max(y), 6) AS hi, round(avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 6) AS zero FROM lb GROUP BY 1")
def btx_label_stats(spark, d):
    zero = F.avg(F.when(F.col("y") == 0, 1).otherwise(0))
    return labels(spark, d).groupBy("brand").agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias("mean"), F.round(F.stddev_pop("y"), 5).alias("sd"), F.round(F.min("y"), 6).alias("lo"), F.round(F.max("y"), 6).alias("hi"), F.round(zero, 6).alias("zero"))


@query(f"WITH {LABELS}, win AS (SELECT CAST(DATE '1996-01-01' + CAST(i AS INTEGER) * 180 AS DATE) AS lo, CAST(DATE '1996-01-01' + CAST(i AS INTEGER) * 180 + 180 AS DATE) AS hi FROM range(8) t(i)) SELECT CAST(lo AS VARCHAR) AS lo, count(*) AS n, round(avg(CASE WHEN fd < hi THEN 1 ELSE 0 END), 6) AS inside FROM lb JOIN win ON d >= win.lo AND d < win.hi GROUP BY win.lo")
def btx_leakage_audit(spark, d):
    at = F.expr("floor(datediff(d, date '1996-01-01') / 180)")
    x = labels(spark, d).withColumn("i", at).where("i >= 0 and i < 8").withColumn("lo", F.expr("date_add(date '1996-01-01', cast(i * 180 as int))"))
    return x.groupBy("lo").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("fd") < F.date_add("lo", 180), 1).otherwise(0)), 6).alias("inside")).withColumn("lo", F.col("lo").cast("string"))


RANKED = f"""{LABELS}, sy AS (SELECT brand, bars.d, CASE WHEN count(ret) OVER w >= 7 THEN sum(ret) OVER w END AS y2 FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d RANGE BETWEEN CURRENT ROW AND INTERVAL 29 DAY FOLLOWING)),
jj AS (SELECT lb.brand, round(y, 9) AS y, round(y2, 9) AS y2 FROM lb JOIN sy ON sy.brand = lb.brand AND sy.d = lb.d WHERE y2 IS NOT NULL),
rk AS (SELECT brand, rank() OVER (PARTITION BY brand ORDER BY y) + (count(*) OVER (PARTITION BY brand, y) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY brand ORDER BY y2) + (count(*) OVER (PARTITION BY brand, y2) - 1) / 2.0 AS r2 FROM jj)"""


@query(f"WITH {RANKED} SELECT brand, round(corr(r1, r2), 4) AS spearman FROM rk GROUP BY 1")
def btx_label_method_correlation(spark, d):
    b = bars(spark, d).withColumn("n", F.unix_date("d").cast("long"))
    w = Window.partitionBy("brand").orderBy("n").rangeBetween(0, 29)
    y2 = b.withColumn("y2", F.round(F.when(F.count("ret").over(w) >= 7, F.sum("ret").over(w)), 9)).where("y2 is not null").select("brand", "d", "y2")
    j = labels(spark, d).withColumn("y", F.round("y", 9)).join(y2, ["brand", "d"])
    r = average_rank(average_rank(j, ["brand"], "y", "r1"), ["brand"], "y2", "r2")
    return r.groupBy("brand").agg(F.round(F.corr("r1", "r2"), 4).alias("spearman"))


STUDY = """z AS (SELECT brand, week, CASE WHEN count(longs) OVER o >= 19 AND stddev_pop(longs) OVER o >= 1e-12 THEN (longs - avg(longs) OVER o) / (stddev_pop(longs) OVER o + 1e-12) END AS z FROM positioning WINDOW o AS (PARTITION BY brand ORDER BY positioning.week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT brand, bars.d, close, lead(close, 5) OVER w AS c5, lead(close, 20) OVER w AS c20 FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)),
e AS (SELECT z.brand, z.week, z.z, min(b.d) AS entry FROM z JOIN b ON b.brand = z.brand AND b.d BETWEEN z.week + INTERVAL 3 DAY AND z.week + INTERVAL 10 DAY WHERE abs(round(z.z, 6)) >= 2 GROUP BY 1, 2, 3)"""


@query(f"WITH {STUDY} SELECT CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS side, count(*) AS events, round(avg(ln(c5 / close)), 5) AS r5, round(avg(ln(c20 / close)), 5) AS r20, round(avg(CASE WHEN c20 > close THEN 1.0 WHEN c20 IS NULL THEN NULL ELSE 0 END), 5) AS hit FROM e JOIN b ON b.brand = e.brand AND b.d = e.entry GROUP BY 1")
def btx_event_study(spark, d):
    from ..operators.joins import asof_join
    from .series import before, z_against

    p = positioning(spark, d).withColumn("z", z_against(F.col("longs"), before(["brand"], "week"), 19)).where("abs(round(z, 6)) >= 2").withColumn("known", F.date_add("week", 3)).select("brand", "week", "z", "known")
    b = bars(spark, d).withColumn("c5", F.lead("close", 5).over(w_brand())).withColumn("c20", F.lead("close", 20).over(w_brand())).select("brand", F.col("d").alias("day"), F.struct("close", "c5", "c20").alias("v"))
    e = asof_join(p, b, ["brand"], "known", "day", "v", "forward").where(F.date_diff(F.col("found.ts"), F.col("known")) <= 7)
    v = F.col("found.value")
    hit = F.when(v["c20"] > v["close"], 1.0).when(v["c20"].isNotNull(), 0.0)
    return e.groupBy(F.when(F.col("z") > 0, "high").otherwise("low").alias("side")).agg(F.count("*").alias("events"), F.round(F.avg(F.log(v["c5"] / v["close"])), 5).alias("r5"), F.round(F.avg(F.log(v["c20"] / v["close"])), 5).alias("r20"), F.round(F.avg(hit), 5).alias("hit"))


@query("""WITH r AS (SELECT brand, bars.d, ret, exp(sum(ret) OVER (PARTITION BY brand ORDER BY bars.d)) AS e FROM bars WHERE ret IS NOT NULL), m AS (SELECT *, e / max(e) OVER (PARTITION BY brand ORDER BY r.d) - 1 AS dd FROM r), v AS (SELECT brand, quantile_cont(ret, 0.05) AS var5 FROM r GROUP BY 1)
SELECT m.brand, round(avg(ret) * 252, 5) AS annual, round(sum(ret), 5) AS total, round(avg(ret) / stddev_pop(ret) * sqrt(252), 5) AS sharpe, round(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252), 5) AS sortino, round(min(dd), 6) AS max_dd, round(any_value(var5), 6) AS var5, round(avg(ret) FILTER (WHERE ret <= var5), 6) AS cvar5
FROM m JOIN v ON v.brand = m.brand GROUP BY 1""")
def btx_score_returns(spark, d):
    w = w_brand().rowsBetween(Window.unboundedPreceding, 0)
    r = bars(spark, d).where("ret is not null").withColumn("e", F.exp(F.sum("ret").over(w)))
    m = r.withColumn("dd", F.col("e") / F.max("e").over(w) - 1)
    v = r.groupBy("brand").agg(F.percentile("ret", 0.05).alias("var5"))
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    return m.join(v, "brand").groupBy("brand").agg(
        F.round(F.avg("ret") * 252, 5).alias("annual"), F.round(F.sum("ret"), 5).alias("total"), F.round(F.avg("ret") / F.stddev_pop("ret") * math.sqrt(252), 5).alias("sharpe"), F.round(F.avg("ret") / down * math.sqrt(252), 5).alias("sortino"),
        F.round(F.min("dd"), 6).alias("max_dd"), F.round(F.first("var5"), 6).alias("var5"), F.round(F.avg(F.when(F.col("ret") <= F.col("var5"), F.col("ret"))), 6).alias("cvar5"),
    )


@query()
def btx_block_bootstrap(spark, d):
    """Circular block bootstrap of the mean return: hash-seeded block starts, joined to the series by index."""
    r = bars(spark, d).where("ret is not null").withColumn("i", F.row_number().over(w_brand()) - 1).select("brand", "i", "ret")
    n = r.groupBy("brand").agg(F.count("*").alias("n")).withColumn("b", F.round(F.pow("n", F.lit(1 / 3))).cast("int"))
    replicas = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("block", F.explode(F.expr("sequence(0, cast(ceil(n / b) as int) - 1)")))
    start = F.pmod(F.xxhash64("brand", "rep", "block"), F.col("n"))
    at = replicas.withColumn("start", start).withColumn("k", F.explode(F.expr("sequence(0, b - 1)"))).where("block * b + k < n").select("brand", "rep", F.pmod(F.col("start") + F.col("k"), F.col("n")).cast("int").alias("i"))
    means = at.join(r, ["brand", "i"]).groupBy("brand", "rep").agg(F.avg("ret").alias("m"))
    return means.groupBy("brand").agg(F.count("*").alias("replicas"), F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"))


FOLDS = "fo AS (SELECT i AS fold, CAST(DATE '1997-01-01' + CAST(i AS INTEGER) * 90 AS DATE) AS lo, CAST(DATE '1997-01-01' + CAST(i AS INTEGER) * 90 + 90 AS DATE) AS hi FROM range(16) t(i))"


def folded(df, first: str, days: int, n: int):
    """Rows with the number of the test fold their day falls into."""
    fold = F.floor(F.date_diff(F.col("d"), F.lit(first).cast("date")) / days)
    return df.withColumn("fold", fold).where((F.col("fold") >= 0) & (F.col("fold") < n))


@query(f"WITH {FOLDS} SELECT fold, count(*) AS n, round(avg(ret), 6) AS mean FROM bars JOIN fo ON d >= lo AND d < hi WHERE ret IS NOT NULL GROUP BY 1")
def btx_mean_log_return(spark, d):
    return folded(bars(spark, d).where("ret is not null"), "1997-01-01", 90, 16).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))


WALK = f"""{FOLDS}, tr AS (SELECT fold, brand, avg(ret) / stddev_pop(ret) AS s FROM bars JOIN fo ON d < lo WHERE ret IS NOT NULL GROUP BY 1, 2), tw AS (SELECT fold, brand, CASE WHEN s > 0 THEN 1.0 ELSE 0 END / greatest(sum(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY fold), 1) AS w FROM tr),
pf AS (SELECT fo.fold, b.d, sum(w * ret) AS r FROM bars b JOIN fo ON b.d >= lo AND b.d < hi JOIN tw ON tw.fold = fo.fold AND tw.brand = b.brand WHERE ret IS NOT NULL GROUP BY 1, 2)"""


def walk_forward(spark, d):
    """Expanding folds: weights from all days before a fold, applied within it. The training statistics of every
    fold come from one grouping by fold and a running sum, not from a join of days with folds."""
    b = bars(spark, d).where("ret is not null")
    fold = F.greatest(F.lit(-1), F.floor(F.date_diff(F.col("d"), F.lit("1997-01-01").cast("date")) / 90))
    part = b.withColumn("fold", fold).where("fold < 16").groupBy("brand", "fold").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    every = b.select("brand").distinct().withColumn("fold", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(15).cast("long"))))
    w = Window.partitionBy("brand").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    tr = every.join(part, ["brand", "fold"], "left").select("brand", "fold", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s")).where("fold >= 0 and n > 0")
    up = F.when(F.col("s") > 0, 1.0).otherwise(0.0)
    tw = tr.withColumn("w", up / F.greatest(F.sum(up).over(Window.partitionBy("fold")), F.lit(1.0))).select("brand", "fold", "w")
    return folded(b, "1997-01-01", 90, 16).join(tw, ["brand", "fold"])


@query(f"WITH {WALK} SELECT fold, count(*) AS days, round(sum(r), 6) AS total, round(avg(r) / greatest(stddev_pop(r), 1e-12), 5) AS sharpe FROM pf GROUP BY 1")
def btx_walk_forward(spark, d):
    pf = walk_forward(spark, d).groupBy("fold", "d").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    return pf.groupBy("fold").agg(F.count("*").alias("days"), F.round(F.sum("r"), 6).alias("total"), F.round(F.avg("r") / F.greatest(F.stddev_pop("r"), F.lit(1e-12)), 5).alias("sharpe"))


@query(f"WITH {WALK} SELECT b.brand, round(sum(w * ret), 6) AS contribution, count(*) AS days FROM bars b JOIN fo ON b.d >= lo AND b.d < hi JOIN tw ON tw.fold = fo.fold AND tw.brand = b.brand WHERE ret IS NOT NULL GROUP BY 1")
def btx_attribution(spark, d):
    return walk_forward(spark, d).groupBy("brand").agg(F.round(F.sum(F.col("w") * F.col("ret")), 6).alias("contribution"), F.count("*").alias("days"))


@query(f"WITH {WALK}, x AS (SELECT CAST(d AS VARCHAR) AS day, r FROM pf), g AS (SELECT fold % 3 AS regime, r FROM pf) SELECT regime, count(*) AS days, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(r), 6) AS mean, count(*) < 20 AS short FROM g GROUP BY 1")
def btx_regime_scores(spark, d):
    pf = walk_forward(spark, d).groupBy("fold", "d").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    g = pf.groupBy((F.col("fold") % 3).alias("regime")).agg(F.count("*").alias("days"), F.avg("r").alias("mean"))
    total = F.broadcast(g.agg(F.sum("days").alias("t")))  # one row
    return g.join(total).select("regime", "days", F.round(F.col("days") / F.col("t"), 6).alias("share"), F.round("mean", 6).alias("mean"), (F.col("days") < 20).alias("short"))


@query("SELECT CAST(d AS VARCHAR) AS d, coalesce(max(ret) FILTER (WHERE brand = 'Brand#11'), 0) AS b11, coalesce(max(ret) FILTER (WHERE brand = 'Brand#12'), 0) AS b12, coalesce(max(ret) FILTER (WHERE brand = 'Brand#13'), 0) AS b13 FROM bars GROUP BY bars.d")
def btx_return_matrix(spark, d):
    wide = bars(spark, d).groupBy("d").pivot("brand", ["Brand#11", "Brand#12", "Brand#13"]).agg(F.max("ret")).fillna(0.0)
    return wide.select(F.col("d").cast("string").alias("d"), *[F.col(f"`Brand#{n}`").alias(f"b{n}") for n in (11, 12, 13)])


@query("WITH w AS (SELECT brand, sum(volume) / sum(sum(volume)) OVER () AS w FROM bars GROUP BY 1) SELECT round(max(w), 6) AS max, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.9), 6) AS p90, round(quantile_cont(w, 0.99), 6) AS p99, round(sum(abs(w)), 6) AS leverage FROM w")
def btx_concentration(spark, d):
    w = weights(spark, d)
    q = lambda p: F.round(F.percentile("w", p), 6)
    return w.agg(F.round(F.max("w"), 6).alias("max"), F.round(F.avg("w"), 6).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.round(F.sum(F.abs("w")), 6).alias("leverage"))


def weights(spark, d):
    v = bars(spark, d).groupBy("brand").agg(F.sum("volume").alias("v"))
    total = F.broadcast(v.agg(F.sum("v").alias("t")))  # one row
    return v.join(total).select("brand", (F.col("v") / F.col("t")).alias("w"))


IC = """sc AS (SELECT brand, bars.d, lag(ret, 1) OVER w AS score, round(ret, 9) AS y FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)), s2 AS (SELECT brand, d, round(score, 9) AS score, y FROM sc WHERE score IS NOT NULL AND y IS NOT NULL),
ir AS (SELECT d, score, y, rank() OVER (PARTITION BY d ORDER BY score) + (count(*) OVER (PARTITION BY d, score) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS r2 FROM s2),
ics AS (SELECT d, corr(r1, r2) AS ic, count(*) AS n FROM ir GROUP BY 1 HAVING count(*) >= 5)"""


def scores(spark, d):
    return bars(spark, d).withColumn("score", F.round(F.lag("ret").over(w_brand()), 9)).withColumn("y", F.round("ret", 9)).where("score is not null and y is not null")


def ics(spark, d):
    r = average_rank(average_rank(scores(spark, d), ["d"], "score", "r1"), ["d"], "y", "r2")
    return r.groupBy("d").agg(F.corr("r1", "r2").alias("ic"), F.count("*").alias("n")).where("n >= 5")


@query(f"WITH {IC} SELECT CAST(d AS VARCHAR) AS dd, round(ic, 5) AS ic, n FROM ics")
def btx_information_coefficient(spark, d):
    return ics(spark, d).select(F.col("d").cast("string").alias("dd"), F.round("ic", 5).alias("ic"), "n")


@query(f"WITH {IC} SELECT year(d) AS y, count(*) AS days, round(avg(ic), 5) AS ic, round(avg(ic) / stddev_samp(ic), 5) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t FROM ics WHERE NOT isnan(ic) GROUP BY 1")
def btx_stratified_ic(spark, d):
    i = ics(spark, d).where("ic is not null and not isnan(ic)")
    ratio = F.avg("ic") / F.stddev_samp("ic")
    return i.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("days"), F.round(F.avg("ic"), 5).alias("ic"), F.round(ratio, 5).alias("icir"), F.round(ratio * F.sqrt(F.count("*")), 4).alias("t"))


@query(f"WITH {IC}, k AS (SELECT s2.*, row_number() OVER (PARTITION BY d ORDER BY score DESC, brand) AS hi, row_number() OVER (PARTITION BY d ORDER BY score, brand) AS lo, count(*) OVER (PARTITION BY d) AS n FROM s2) SELECT CAST(d AS VARCHAR) AS dd, round(avg(y) FILTER (WHERE hi <= 3) - avg(y) FILTER (WHERE lo <= 3), 6) AS spread FROM k WHERE n >= 6 GROUP BY k.d")
def btx_long_short(spark, d):
    w = Window.partitionBy("d")
    k = scores(spark, d).withColumn("hi", F.row_number().over(w.orderBy(F.desc("score"), "brand"))).withColumn("lo", F.row_number().over(w.orderBy("score", "brand"))).withColumn("n", F.count("*").over(w)).where("n >= 6")
    side = lambda c: F.avg(F.when(F.col(c) <= 3, F.col("y")))
    return k.groupBy("d").agg(F.round(side("hi") - side("lo"), 6).alias("spread")).select(F.col("d").cast("string").alias("dd"), "spread")


@query("""WITH v AS (SELECT brand, sum(volume) / sum(sum(volume)) OVER () AS w FROM bars GROUP BY 1), p AS (SELECT b.d, sum(w * coalesce(ret, 0)) AS r, avg(coalesce(ret, 0)) AS bench FROM bars b JOIN v ON v.brand = b.brand GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS dd, round(r, 6) AS r, round(bench, 6) AS bench, round(sum(r) OVER (ORDER BY p.d), 5) AS cumulative FROM p""")
def btx_paper_pnl(spark, d):
    return pnl(spark, d).select(F.col("d").cast("string").alias("dd"), F.round("r", 6).alias("r"), F.round("bench", 6).alias("bench"), F.round("cumulative", 5).alias("cumulative"))


def pnl(spark, d):
    """Daily return of held weights; one row per day, so the running sum is a small window."""
    x = F.coalesce("ret", F.lit(0.0))
    p = bars(spark, d).join(weights(spark, d), "brand").groupBy("d").agg(F.sum(F.col("w") * x).alias("r"), F.avg(x).alias("bench"))
    return p.withColumn("cumulative", F.sum("r").over(Window.orderBy("d")))


@query("WITH v AS (SELECT brand, sum(volume) / sum(sum(volume)) OVER () AS w FROM bars GROUP BY 1) SELECT brand, round(w, 6) AS w FROM v WHERE abs(w) > 0.04")
def btx_concentration_check(spark, d):
    return weights(spark, d).where("abs(w) > 0.04").select("brand", F.round("w", 6).alias("w"))


@query("""WITH v AS (SELECT brand, sum(volume) / sum(sum(volume)) OVER () AS w FROM bars GROUP BY 1), p AS (SELECT b.d, sum(w * coalesce(ret, 0)) AS r FROM bars b JOIN v ON v.brand = b.brand GROUP BY 1), e AS (SELECT p.d, exp(sum(r) OVER (ORDER BY p.d)) AS e FROM p), m AS (SELECT e.d, e / max(e) OVER (ORDER BY e.d) - 1 AS dd FROM e)
SELECT CAST(d AS VARCHAR) AS dd, round(dd, 5) AS drawdown FROM m WHERE dd < -0.05""")
def btx_drawdown_check(spark, d):
    e = pnl(spark, d).withColumn("e", F.exp("cumulative"))
    m = e.withColumn("x", F.col("e") / F.max("e").over(Window.orderBy("d")) - 1)
    return m.where("x < -0.05").select(F.col("d").cast("string").alias("dd"), F.round("x", 5).alias("drawdown"))


@query("""WITH v AS (SELECT brand, sum(volume) / sum(sum(volume)) OVER () AS w FROM bars GROUP BY 1), p AS (SELECT b.d, sum(w * coalesce(ret, 0)) AS r FROM bars b JOIN v ON v.brand = b.brand GROUP BY 1) SELECT round(avg(r) / stddev_pop(r) * sqrt(252), 5) AS sharpe, max(d) - min(d) >= 30 AS seasoned, avg(r) / stddev_pop(r) * sqrt(252) < -0.5 AS breach FROM p""")
def btx_sharpe_check(spark, d):
    s = F.avg("r") / F.stddev_pop("r") * math.sqrt(252)
    return pnl(spark, d).agg(F.round(s, 5).alias("sharpe"), (F.date_diff(F.max("d"), F.min("d")) >= 30).alias("seasoned"), (s < -0.5).alias("breach"))


@query("WITH h AS (SELECT brand FROM bars GROUP BY 1 HAVING sum(volume) > 55000), f AS (SELECT brand FROM bars WHERE ret < -1 GROUP BY 1) SELECT brand FROM h WHERE brand IN (SELECT brand FROM f)")
def btx_decay_check(spark, d):
    b = bars(spark, d)
    held = b.groupBy("brand").agg(F.sum("volume").alias("v")).where("v > 55000").select("brand")
    return held.join(b.where("ret < -1").select("brand").distinct(), "brand", "left_semi")


@query("""SELECT brand, CAST(d AS VARCHAR) AS dd, CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS direction, ret FROM bars WHERE d BETWEEN DATE '1998-01-10' - 365 AND DATE '1998-01-10' AND brand IN (SELECT brand FROM bars WHERE d BETWEEN DATE '1998-01-10' - 365 AND DATE '1998-01-10' GROUP BY 1 HAVING count(*) >= 2)""")
def btx_historical_evidence(spark, d):
    b = bars(spark, d).where("d between date_sub(date '1998-01-10', 365) and date '1998-01-10'").withColumn("n", F.count("*").over(Window.partitionBy("brand"))).where("n >= 2")
    return b.select("brand", F.col("d").cast("string").alias("dd"), F.when(F.col("ret") > 0.1, 1).when(F.col("ret") < -0.1, -1).otherwise(0).alias("direction"), "ret")


STRATEGIES = ("buy_and_hold", "equal_weight", "risk_off", "directional")


@query("""WITH m AS (SELECT d, avg(coalesce(ret, 0)) AS r FROM bars GROUP BY 1), v AS (SELECT m.d, r, avg(r) OVER (ORDER BY m.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a, stddev_pop(r) OVER (ORDER BY m.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS s FROM m)
SELECT strategy, round(sum(w * r), 5) AS total, count(*) AS days FROM (SELECT r, unnest(['buy_and_hold', 'equal_weight', 'risk_off', 'directional']) AS strategy, unnest([1.0, 0.04, CASE WHEN s > 0.05 THEN 0.0 ELSE 1.0 END, coalesce(sign(a), 0)]) AS w FROM v) GROUP BY 1""")
def btx_builtin_strategies(spark, d):
    """Weights of each strategy on the market's daily return, all in one pass; one row per day comes in."""
    m = bars(spark, d).groupBy("d").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("r"))
    w = Window.orderBy("d").rowsBetween(-20, -1)
    v = m.withColumn("a", F.avg("r").over(w)).withColumn("s", F.stddev_pop("r").over(w))
    weights_of = [F.lit(1.0), F.lit(0.04), F.when(F.col("s") > 0.05, 0.0).otherwise(1.0), F.coalesce(F.signum("a"), F.lit(0.0))]
    each = v.select("r", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in STRATEGIES]).alias("strategy"), F.array(*weights_of).alias("w"))).alias("x"))
    return each.groupBy("x.strategy").agg(F.round(F.sum(F.col("x.w") * F.col("r")), 5).alias("total"), F.count("*").alias("days"))


@query("""WITH s AS (SELECT brand, bars.d, ret AS y, round(lag(ret) OVER w, 9) AS f1, round(lag(volume) OVER w, 9) AS f2, round(lag(high / low) OVER w, 9) AS f3 FROM bars WINDOW w AS (PARTITION BY brand ORDER BY bars.d)), k AS (SELECT * FROM s WHERE y IS NOT NULL AND f1 IS NOT NULL),
a AS (SELECT round(corr(f1, y), 5) AS c1, round(corr(f2, y), 5) AS c2, round(corr(f3, y), 5) AS c3 FROM k) SELECT masked, score FROM (SELECT unnest(['none', 'ret', 'volume', 'range']) AS masked, unnest([round(abs(c1) + abs(c2) + abs(c3), 4), round(abs(c2) + abs(c3), 4), round(abs(c1) + abs(c3), 4), round(abs(c1) + abs(c2), 4)]) AS score FROM a)""")
def btx_source_ablation(spark, d):
    """The sum of absolute correlations with one source masked, beside the full one."""
    w = w_brand()
    s = bars(spark, d).select("brand", F.col("ret").alias("y"), F.round(F.lag("ret").over(w), 9).alias("f1"), F.round(F.lag("volume").over(w), 9).alias("f2"), F.round(F.lag(F.col("high") / F.col("low")).over(w), 9).alias("f3")).where("y is not null and f1 is not null")
    a = s.agg(*[F.abs(F.round(F.corr(f, "y"), 5)).alias(f) for f in ("f1", "f2", "f3")])
    score = lambda *fs: F.round(sum((F.col(f) for f in fs[1:]), F.col(fs[0])), 4)
    rows = [("none", score("f1", "f2", "f3")), ("ret", score("f2", "f3")), ("volume", score("f1", "f3")), ("range", score("f1", "f2"))]
    return a.select(F.explode(F.array(*[F.struct(F.lit(m).alias("masked"), v.alias("score")) for m, v in rows])).alias("x")).select("x.masked", "x.score")


@query(f"WITH {WALK} SELECT CAST(d AS VARCHAR) AS dd, round(r, 6) AS r FROM pf")
def btx_multi_asset_walk_forward(spark, d):
    pf = walk_forward(spark, d).groupBy("d").agg(F.round(F.sum(F.col("w") * F.col("ret")), 6).alias("r"))
    return pf.select(F.col("d").cast("string").alias("dd"), "r")
