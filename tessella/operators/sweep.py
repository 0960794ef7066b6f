"""The convergence detector at every week of a history in one plan, and strategies on its scores.

A step of the sweep is what one detection as of that week would see: the last
LOOKBACK weeks. Nothing is computed anew for a step: the pair tests are window
frames over each pair's weekly rows, corrected step by step, and the graphs of
all steps are one graph, as a node is a week and a signal, so cliques of all
steps grow in the same few rounds. Work grows with pairs times weeks, not with
the rows behind the weekly values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from .graphs import cliques
from .stats import benjamini_hochberg, rolling_corr

LOOKBACK, CORR = 52, 12


def weekly(series: DataFrame) -> DataFrame:
    """signal, category, w and value on every week from a signal's first to its last; a week without rows has the value before it. series: signal, category, d, value."""
    w = F.to_date(F.date_trunc("week", "d"))
    sums = series.groupBy("signal", "category", w.alias("w")).agg(F.round(F.sum("value"), 6).alias("value"))
    every = sums.groupBy("signal", "category").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).select("signal", "category", F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("w"))
    before = Window.partitionBy("signal").orderBy("w")
    return every.join(sums, ["signal", "category", "w"], "left").withColumn("value", F.last("value", ignorenulls=True).over(before))


def pair_tests(grid: DataFrame, lookback: int = LOOKBACK, corr: int = CORR) -> DataFrame:
    """w, sa, sb, p, weight and direction of each pair of signals at each week with a full lookback: Fisher's combination of a
    correlation break, joint exceedance and concordance, all of the lookback's weeks only."""
    side = lambda s, v: grid.select("w", F.col("signal").alias(s), F.col("value").alias(v))
    pairs = side("sa", "x").join(side("sb", "y"), "w").where("sa < sb")
    w = Window.partitionBy("sa", "sb").orderBy("w")
    span, recent = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(corr - 1), 0)
    earlier, moves = w.rowsBetween(-(lookback - corr), -1), w.rowsBetween(-(lookback - 2), 0)
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    rows = pairs.select("*", rolling_corr("x", "y", recent).alias("c"), (step("x") == step("y")).cast("long").alias("same"), F.row_number().over(w).alias("i"))
    stat = lambda f, c, over, name: f(c).over(over).alias(name)
    stats = rows.select(
        "*", stat(F.avg, "c", earlier, "m"), stat(F.stddev_samp, "c", earlier, "sd"), stat(F.sum, "same", moves, "k"),
        *[stat(f, c, span, f"{n}{c}") for c in "xy" for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))], F.collect_list(F.struct("x", "y")).over(span).alias("seen"),
    ).where(F.col("i") >= lookback)
    far = lambda v, c: F.coalesce(F.abs((v[c] - F.col(f"m{c}")) / F.col(f"s{c}")) > 1, F.lit(False))
    hits = stats.select(
        "w", "sa", "sb", ((F.col("c") - F.col("m")) / F.col("sd")).alias("z"), F.col("k").cast("double").alias("k"),
        *[F.size(F.filter("seen", f)).cast("double").alias(n) for n, f in (("nx", lambda v: far(v, "x")), ("ny", lambda v: far(v, "y")), ("joint", lambda v: far(v, "x") & far(v, "y")))],
    )
    n, moved = F.lit(float(lookback)), F.lit(float(lookback - 1))
    both = F.least(S.binomial_upper(F.col("k"), moved, F.lit(0.5)), S.binomial_upper(moved - F.col("k"), moved, F.lit(0.5)))
    tests = hits.select(
        "w", "sa", "sb", "z", "k", S.two_sided_p(F.col("z")).alias("p1"),
        S.binomial_upper(F.col("joint"), n, F.col("nx") / n * F.col("ny") / n).alias("p2"), F.least(F.lit(1.0), 2 * both).alias("p3"),
    ).where("z is not null")
    chi = -2 * sum((F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p1", "p2", "p3")), F.lit(0.0))
    return tests.select("w", "sa", "sb", S.chi2_even_tail(chi, 3).alias("p"), F.abs("z").alias("weight"), F.when(F.col("k") / moved >= 0.5, 1).otherwise(-1).alias("direction"))


def node(signal: str) -> Column:
    return F.concat(F.col("w").cast("string"), F.lit("|"), F.col(signal))


def scored(found: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """members, score and direction of cliques. edges: a, b (a < b), weight, direction; categories: node, category."""
    m = found.select("members", F.explode("members").alias("a"))
    c = m.join(categories.withColumnRenamed("node", "a"), "a").groupBy("members").agg(F.countDistinct("category").alias("categories"))
    inside = m.join(edges, "a").where(F.array_contains("members", F.col("b"))).groupBy("members").agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("direction")).alias("vote"))
    n = F.size("members")
    raw = F.col("total") / n * F.col("categories") / n * F.log2(n.cast("double"))
    return inside.join(c, "members").select("members", S.sigmoid_score(raw).alias("score"), F.signum("vote").cast("int").alias("direction"))


def template_matches(found: DataFrame, grid: DataFrame, templates: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """members and match: the largest share of a template's steps that some member fits by category, name and the side of its mean.
    templates: template, step, cat, pattern, sign (0: any); a rule table."""
    span = Window.partitionBy("signal").orderBy("w").rowsBetween(-(lookback - 1), 0)
    sides = grid.select(node("signal").alias("a"), "signal", "category", F.signum(F.col("value") - F.avg("value").over(span)).alias("side"))
    sizes = templates.groupBy("template").agg(F.count("*").alias("steps"))
    fits = (F.col("category") == F.col("cat")) & F.expr("signal rlike pattern") & ((F.col("sign") == 0) | (F.col("side") == F.col("sign")))
    met = found.select("members", F.explode("members").alias("a")).join(sides, "a").join(F.broadcast(templates), fits)
    share = met.groupBy("members", "template").agg(F.countDistinct("step").alias("met")).join(F.broadcast(sizes), "template")
    return share.groupBy("members").agg(F.max(F.col("met") / F.col("steps")).alias("match"))


def step_scores(grid: DataFrame, templates: DataFrame, q: float = 0.05, least: int = 2, min_categories: int = 2, min_persistence: int = 1, boost: float = 0.5, lookback: int = LOOKBACK, corr: int = CORR) -> DataFrame:
    """A row for each week of the grid: w, score, direction, n_cliques and template_match of its best clique, zeros where nothing converges.

    A clique counts at a week if the same members formed one at min_persistence weeks in a row, this one the last.
    """
    grid = written(grid, "grid")
    tests = benjamini_hochberg(pair_tests(grid, lookback, corr), "p", q, ["w"]).where("rejected")
    edges = written(tests.select(node("sa").alias("a"), node("sb").alias("b"), "weight", "direction"), "edges")
    categories = grid.select(node("signal").alias("node"), "category")
    found = written(cliques(edges.select("a", "b"), least, categories, min_categories), "cliques")
    prefix = F.substring(F.element_at("members", 1), 1, 10)
    each = scored(found, edges, categories).join(template_matches(found, grid, templates, lookback), "members", "left")
    week = each.select("*", prefix.cast("date").alias("w"), F.array_join(F.transform("members", lambda m: F.substring(m, 12, 1 << 20)), "|").alias("fingerprint"))
    number = F.datediff("w", F.lit("1970-01-01").cast("date")) / 7
    island = number - F.row_number().over(Window.partitionBy("fingerprint").orderBy("w"))
    week = week.withColumn("island", island).withColumn("streak", F.row_number().over(Window.partitionBy("fingerprint", "island").orderBy("w"))).where(F.col("streak") >= min_persistence)
    match = F.coalesce("match", F.lit(0.0))
    boosted = F.least(F.lit(1.0), F.col("score") * (1 + boost * match))
    best = F.max_by(F.struct(boosted.alias("score"), "direction", match.alias("match")), F.struct(boosted, "fingerprint"))
    top = week.groupBy("w").agg(best.alias("best"), F.count("*").alias("n"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    weeks = grid.select("w").distinct()
    return weeks.join(top, "w", "left").select("w", zero("best.score", "double").alias("score"), zero("best.direction", "int").alias("direction"), zero("n", "long").alias("n_cliques"), zero("best.match", "double").alias("template_match"))


def strategies(threshold: float = 0.3, match_threshold: float = 0.5, scale: float = 1.0) -> dict[str, Column]:
    """Weights of a target at a week, from its step's score."""
    stress = F.col("direction") >= 1
    out = lambda c: F.when(c, 0.0).otherwise(1.0)
    return {
        "convergence_risk_off": out(stress & (F.col("score") > threshold)),
        "convergence_directional": F.when(stress, F.greatest(1 - F.least(F.col("score") * scale, F.lit(1.0)), F.lit(0.0))).otherwise(1.0),
        "convergence_template": out(stress & (F.col("score") > threshold) & (F.col("template_match") > match_threshold)),
        "buy_and_hold": F.lit(1.0),
    }


def walk_forward(returns: DataFrame, scores: DataFrame, min_train: int = 52, test_size: int = 12) -> DataFrame:
    """target, strategy, i (the week's number among the tested), w, fold, regime and r. returns: target, w, ret.

    Weeks before min_train aren't tested; folds follow each other, and weeks after the last whole fold are left out. The
    strategies learn nothing, so a fold is only a label.
    """
    by = Window.partitionBy("target")
    numbered = returns.select("*", (F.row_number().over(by.orderBy("w")) - 1 - min_train).alias("i"), F.count("*").over(by).alias("n"))
    whole = F.floor((F.col("n") - min_train) / test_size) * test_size
    tested = numbered.where((F.col("i") >= 0) & (F.col("i") < whole)).join(scores, "w", "left")
    filled = tested.select("target", "w", "i", "ret", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("score", "direction", "template_match")])
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), w.cast("double").alias("weight")) for n, w in strategies().items()])).alias("s")
    regime = F.when(F.col("direction") >= 1, "stress").when(F.col("direction") <= -1, "relief").otherwise("quiet")
    each = filled.select("target", "w", "i", "ret", regime.alias("regime"), kinds)
    return each.select("target", F.col("s.strategy").alias("strategy"), "i", "w", F.floor(F.col("i") / test_size).alias("fold"), "regime", (F.col("s.weight") * F.col("ret")).alias("r"))


def sharpe(r: str, periods: int = 52) -> Column:
    sd = F.stddev_pop(r)
    return F.when(sd > 1e-15, F.avg(r) / sd * float(periods) ** 0.5).otherwise(0.0)


def bootstrap(tested: DataFrame, replicas: int = 200, block: int = 4) -> DataFrame:
    """target, strategy, ci_lo and ci_hi of the Sharpe ratio, over circular blocks whose starts follow from a hash of target, replica and block, the same for all strategies."""
    sizes = tested.groupBy("target", "strategy").agg(F.count("*").alias("n"))
    drawn = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("rep")).select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("at"))
    start = F.pmod(F.xxhash64("target", "rep", "at"), F.col("n"))
    rows = drawn.select("*", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j")).where(f"at * {block} + j < n")
    rows = rows.select("target", "strategy", "rep", F.pmod(F.col("start") + F.col("j"), F.col("n")).alias("i"))
    each = rows.join(tested.select("target", "strategy", F.col("i").cast("long").alias("i"), "r"), ["target", "strategy", "i"]).groupBy("target", "strategy", "rep").agg(sharpe("r").alias("s"))
    return each.groupBy("target", "strategy").agg(F.percentile("s", 0.025).alias("ci_lo"), F.percentile("s", 0.975).alias("ci_hi"))
