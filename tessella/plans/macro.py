"""The macro backtest: the detector's scores at every week as weights of targets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sweep
from ..registry import query
from ..session import written
from .convergence import TEMPLATES
from .views import bars, series

#: The false-discovery rate of the queries, as in `cnv_detect`.
RATE = 0.2


def scores(spark, d):
    rules = spark.createDataFrame([t[:5] for t in TEMPLATES], "template string, step int, cat string, pattern string, sign int")
    return written(sweep.step_scores(sweep.weekly(series(spark, d)), rules, RATE), "step-scores")


def weekly_returns(spark, d):
    """Each brand is a target: the log return of its last close of a week."""
    last = bars(spark, d).groupBy(F.col("brand").alias("target"), F.to_date(F.date_trunc("week", "d")).alias("w")).agg(F.max_by("close", "d").alias("close"))
    ret = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("target").orderBy("w")))
    return last.select("target", "w", ret.alias("ret")).where("ret is not null")


def tested(spark, d):
    return written(sweep.walk_forward(weekly_returns(spark, d), scores(spark, d)), "tested")


@query()
def btx_convergence_scores(spark, d):
    """One plan for all weeks; each is what a detection as of that week gives."""
    return scores(spark, d).select(F.col("w").cast("string").alias("w"), F.round("score", 6).alias("score"), "direction", "n_cliques", F.round("template_match", 6).alias("template_match"))


@query()
def btx_macro_backtest(spark, d):
    """Three strategies and buy and hold on every target, with a block bootstrap of each Sharpe ratio."""
    t = tested(spark, d)
    each = t.groupBy("target", "strategy").agg(F.count("*").alias("weeks"), F.countDistinct("fold").alias("folds"), F.sum("r").alias("total"), sweep.sharpe("r").alias("sharpe"))
    hold = each.where("strategy = 'buy_and_hold'").select("target", F.col("sharpe").alias("hold"))
    out = each.join(hold, "target").join(sweep.bootstrap(t), ["target", "strategy"])
    number = lambda c: F.round(c, 6)
    return out.select("target", "strategy", "weeks", "folds", number("total").alias("total"), number("sharpe").alias("sharpe"), number(F.col("sharpe") - F.col("hold")).alias("sharpe_diff"), number("ci_lo").alias("ci_lo"), number("ci_hi").alias("ci_hi"))


@query()
def btx_macro_regimes(spark, d):
    """The same returns by the side of the week's convergence."""
    return tested(spark, d).groupBy("target", "strategy", "regime").agg(F.count("*").alias("weeks"), F.round(F.avg("r"), 6).alias("mean"))
