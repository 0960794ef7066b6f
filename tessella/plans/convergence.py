"""Signal convergence: grids, pair scores, false-discovery control, cliques."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graphs import cliques
from ..operators.joins import asof_join
from ..operators.stats import benjamini_hochberg, rolling_corr
from ..operators.sweep import scored
from ..registry import query
from ..session import written
from .views import obs, series


@query("SELECT signal, unnest(generate_series((lo // 7) * 7, hi, 7)) AS t FROM (SELECT signal, min(d) - DATE '1970-01-01' AS lo, max(d) - DATE '1970-01-01' AS hi FROM series GROUP BY 1)")
def cnv_make_grid(spark, d):
    s = series(spark, d).groupBy("signal").agg(F.unix_date(F.min("d")).cast("long").alias("lo"), F.unix_date(F.max("d")).cast("long").alias("hi"))
    return s.select("signal", F.explode(F.expr("sequence((lo div 7) * 7, hi, 7L)")).alias("t"))


@query("""WITH g AS (SELECT source, i FROM (SELECT DISTINCT source FROM obs), range(0, 30 * 24) t(i)), e AS (SELECT DISTINCT source, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS i FROM obs)
SELECT g.source, g.i, CASE WHEN e.i IS NULL THEN 0 ELSE 1 END AS flag FROM g LEFT JOIN e ON e.source = g.source AND e.i = g.i""")
def cnv_align_events(spark, d):
    o = obs(spark, d)
    start = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    e = o.select("source", F.floor((F.unix_timestamp("ts") - start) / 3600).alias("i")).distinct().withColumn("hit", F.lit(1))
    grid = o.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30 * 24 - 1).cast("long"))).alias("i"))
    return grid.join(e, ["source", "i"], "left").select("source", "i", F.coalesce("hit", F.lit(0)).alias("flag"))


WEEKS = "wk AS (SELECT signal, category, CAST(date_trunc('week', d) AS DATE) AS w, sum(value) AS v FROM series GROUP BY 1, 2, 3)"
PAIRS = f"""{WEEKS}, pr AS (SELECT a.signal AS sa, b.signal AS sb, a.category AS ca, b.category AS cb, a.w, round(a.v, 6) AS x, round(b.v, 6) AS y FROM wk a JOIN wk b ON a.w = b.w AND a.signal < b.signal)"""


def pairs(spark, d):
    """Weekly values of every pair of signals on their common weeks. Signals are named series, whose number doesn't grow with the rows behind them."""
    s = series(spark, d)
    w = s.groupBy("signal", "category", F.to_date(F.date_trunc("week", "d")).alias("w")).agg(F.round(F.sum("value"), 6).alias("v"))
    a = w.select("w", F.col("signal").alias("sa"), F.col("category").alias("ca"), F.col("v").alias("x"))
    b = w.select("w", F.col("signal").alias("sb"), F.col("category").alias("cb"), F.col("v").alias("y"))
    return a.join(b, "w").where("sa < sb")


@query(f"WITH {PAIRS} SELECT sa, sb, count(*) AS n, CAST(min(w) AS VARCHAR) AS lo, CAST(max(w) AS VARCHAR) AS hi FROM pr GROUP BY 1, 2")
def cnv_align_pair(spark, d):
    return pairs(spark, d).groupBy("sa", "sb").agg(F.count("*").alias("n"), F.min("w").cast("string").alias("lo"), F.max("w").cast("string").alias("hi"))


@query("SELECT signal, CAST(d AS VARCHAR) AS dd, round(CASE WHEN coalesce(stddev_samp(value) OVER w, 0) < 1e-12 THEN 0 ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 5) AS z FROM series WINDOW w AS (PARTITION BY signal)")
def cnv_zscore_series(spark, d):
    w = Window.partitionBy("signal")
    sd = F.stddev_samp("value").over(w)
    return series(spark, d).select("signal", F.col("d").cast("string").alias("dd"), F.round(F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise((F.col("value") - F.avg("value").over(w)) / sd), 5).alias("z"))


CORR_SQL = f"""WITH {PAIRS}, c0 AS (SELECT sa, sb, w, corr(x, y) OVER (PARTITION BY sa, sb ORDER BY pr.w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c, row_number() OVER (PARTITION BY sa, sb ORDER BY pr.w) AS n, row_number() OVER (PARTITION BY sa, sb ORDER BY pr.w DESC) AS k FROM pr),
c AS (SELECT * REPLACE (CASE WHEN isnan(c) THEN NULL ELSE c END AS c) FROM c0),
s AS (SELECT sa, sb, max(c) FILTER (WHERE k = 1) AS last, avg(c) FILTER (WHERE k > 1 AND k <= 101) AS m, stddev_samp(c) FILTER (WHERE k > 1 AND k <= 101) AS sd FROM c WHERE n >= 20 GROUP BY 1, 2)
SELECT sa, sb, round(last, 4) AS corr, round((last - m) / sd, 4) AS z FROM s"""


def corr_scores(spark, d):
    """z of the last rolling correlation against up to 100 earlier ones."""
    w = Window.partitionBy("sa", "sb").orderBy("w")
    c = pairs(spark, d).withColumn("c", rolling_corr("x", "y", w.rowsBetween(-19, 0))).withColumn("n", F.row_number().over(w)).where("n >= 20")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("sa", "sb").orderBy(F.desc("w"))))
    old = F.when((F.col("k") > 1) & (F.col("k") <= 101), F.col("c"))
    g = c.groupBy("sa", "sb").agg(F.max(F.when(F.col("k") == 1, F.col("c"))).alias("last"), F.avg(old).alias("m"), F.stddev_samp(old).alias("sd"))
    return g.select("sa", "sb", "last", ((F.col("last") - F.col("m")) / F.col("sd")).alias("z"))


@query(CORR_SQL)
def cnv_rolling_corr_score(spark, d):
    return corr_scores(spark, d).select("sa", "sb", F.round("last", 4).alias("corr"), F.round("z", 4).alias("z"))


EXC = f"""{PAIRS}, zz AS (SELECT sa, sb, abs((x - avg(x) OVER q) / stddev_samp(x) OVER q) > 1 AS ex, abs((y - avg(y) OVER q) / stddev_samp(y) OVER q) > 1 AS ey FROM pr WINDOW q AS (PARTITION BY sa, sb)),
ex AS (SELECT sa, sb, count(*) AS n, count(*) FILTER (WHERE ex) AS nx, count(*) FILTER (WHERE ey) AS ny, count(*) FILTER (WHERE ex AND ey) AS joint FROM zz GROUP BY 1, 2)"""


def exceedances(spark, d):
    q = Window.partitionBy("sa", "sb")
    out = lambda c: F.abs((F.col(c) - F.avg(c).over(q)) / F.stddev_samp(c).over(q)) > 1
    z = pairs(spark, d).select("sa", "sb", out("x").alias("ex"), out("y").alias("ey"))
    return z.groupBy("sa", "sb").agg(F.count("*").alias("n"), F.count_if("ex").alias("nx"), F.count_if("ey").alias("ny"), F.count_if(F.col("ex") & F.col("ey")).alias("joint"))


BINOM = "(SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))) FROM range(CAST({k} AS BIGINT), {n} + 1) t(i))"


@query(f"WITH {EXC} SELECT sa, sb, joint, round(CASE WHEN joint = 0 THEN 1 ELSE least(1, {BINOM.format(n='ex.n', k='ex.joint', p='(nx / n * ny / n)')}) END, 6) AS p FROM ex")
def cnv_joint_exceedance(spark, d):
    e = exceedances(spark, d)
    p = S.binomial_upper(F.col("joint").cast("double"), F.col("n").cast("double"), F.col("nx") / F.col("n") * F.col("ny") / F.col("n"))
    return e.select("sa", "sb", "joint", F.round(p, 6).alias("p"))


CONC = f"""{PAIRS}, df AS (SELECT sa, sb, x - lag(x) OVER q AS dx, y - lag(y) OVER q AS dy FROM pr WINDOW q AS (PARTITION BY sa, sb ORDER BY pr.w)), cc AS (SELECT sa, sb, count(*) AS n, count(*) FILTER (WHERE sign(dx) = sign(dy)) AS k FROM df WHERE dx IS NOT NULL GROUP BY 1, 2)"""


def concordances(spark, d):
    w = Window.partitionBy("sa", "sb").orderBy("w")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    x = pairs(spark, d).select("sa", "sb", step("x").alias("dx"), step("y").alias("dy")).where("dx is not null")
    return x.groupBy("sa", "sb").agg(F.count("*").alias("n"), F.count_if(F.signum("dx") == F.signum("dy")).alias("k"))


@query(f"WITH {CONC} SELECT sa, sb, round(k / n, 6) AS share, round(least(1, 2 * least({BINOM.format(n='cc.n', k='cc.k', p='0.5')}, {BINOM.format(n='cc.n', k='(cc.n - cc.k)', p='0.5')})), 6) AS p FROM cc")
def cnv_concordance(spark, d):
    return concordance_p(concordances(spark, d)).select("sa", "sb", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round("p", 6).alias("p"))


def concordance_p(c):
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    both = F.least(S.binomial_upper(k, n, F.lit(0.5)), S.binomial_upper(n - k, n, F.lit(0.5)))
    return c.withColumn("p", F.least(F.lit(1.0), 2 * both))


def combined(spark, d):
    """Three tests of each pair and Fisher's combination of their p on six degrees of freedom."""
    a = corr_scores(spark, d).select("sa", "sb", "z", S.two_sided_p(F.col("z")).alias("p1"))
    e = exceedances(spark, d)
    b = e.select("sa", "sb", S.binomial_upper(F.col("joint").cast("double"), F.col("n").cast("double"), F.col("nx") / F.col("n") * F.col("ny") / F.col("n")).alias("p2"))
    c = concordance_p(concordances(spark, d)).select("sa", "sb", F.col("p").alias("p3"), (F.col("k") / F.col("n")).alias("share"))
    j = a.join(b, ["sa", "sb"]).join(c, ["sa", "sb"])
    chi = -2 * sum((F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p1", "p2", "p3")), F.lit(0.0))
    return j.withColumn("p", S.chi2_even_tail(chi, 3)).withColumn("weight", F.abs("z")).withColumn("direction", F.when(F.col("share") >= 0.5, 1).otherwise(-1))


def normal_cdf_sql(x: str) -> str:
    """DuckDB has no erf: the series of the normal distribution function, summed in logarithms; beyond 9 deviations 0 or 1."""
    term = f"exp((2 * n + 1) * ln(abs({x})) - {x} * {x} / 2 - (n + 1) * ln(2.0) - lgamma(n + 1.5) + 0.5 * ln(pi()))"
    part = f"list_sum(list_transform(range(0, 160), lambda n: {term})) / sqrt(2 * pi())"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 9 THEN 1.0 WHEN {x} < -9 THEN 0.0 WHEN abs({x}) < 1e-12 THEN 0.5 ELSE 0.5 + sign({x}) * {part} END)"


def combined_sql() -> str:
    """A CTE list that ends in cb: sa, sb, weight, p, direction."""
    corr = CORR_SQL.removeprefix("WITH ")
    corr = corr[: corr.index("SELECT sa, sb, round(last, 4)")].rstrip()
    joint = BINOM.format(n="ex.n", k="ex.joint", p="(nx / n * ny / n)")
    up, down = BINOM.format(n="cc.n", k="cc.k", p="0.5"), BINOM.format(n="cc.n", k="(cc.n - cc.k)", p="0.5")
    return f"""WITH {corr}, {EXC.removeprefix(PAIRS + ", ")}, {CONC.removeprefix(PAIRS + ", ")},
q1 AS (SELECT sa, sb, (last - m) / sd AS z, abs((last - m) / sd) AS az FROM s), q2 AS (SELECT sa, sb, CASE WHEN joint = 0 THEN 1 ELSE least(1, {joint}) END AS p2 FROM ex), q3 AS (SELECT sa, sb, k / n AS share, least(1, 2 * least({up}, {down})) AS p3 FROM cc),
q AS (SELECT q1.sa, q1.sb, az AS weight, share, -2 * (ln(greatest(2 * (1 - {normal_cdf_sql('az')}), 1e-300)) + ln(greatest(p2, 1e-300)) + ln(greatest(p3, 1e-300))) / 2 AS h FROM q1 JOIN q2 ON q1.sa = q2.sa AND q1.sb = q2.sb JOIN q3 ON q1.sa = q3.sa AND q1.sb = q3.sb),
cb AS (SELECT sa, sb, weight, exp(-h) * (1 + h + h * h / 2) AS p, CASE WHEN share >= 0.5 THEN 1 ELSE -1 END AS direction FROM q)"""


@query(f"{combined_sql()} SELECT sa, sb, round(weight, 4) AS weight, round(p, 4) AS p, direction FROM cb")
def cnv_combined_coincidence(spark, d):
    return combined(spark, d).select("sa", "sb", F.round("weight", 4).alias("weight"), F.round("p", 4).alias("p"), "direction")


@query(f"""WITH {CONC}, p AS (SELECT sa, sb, least(1, 2 * least({BINOM.format(n='cc.n', k='cc.k', p='0.5')}, {BINOM.format(n='cc.n', k='(cc.n - cc.k)', p='0.5')})) AS p FROM cc), k AS (SELECT *, count(*) OVER (ORDER BY round(p, 9) RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS m FROM p),
a AS (SELECT sa, sb, min(least(1, p * m / k)) OVER (ORDER BY round(p, 9) DESC RANGE UNBOUNDED PRECEDING) AS q FROM k) SELECT sa, sb, round(q, 5) AS p_adjusted, q <= 0.25 AS rejected FROM a""")
def cnv_benjamini_hochberg(spark, d):
    c = concordance_p(concordances(spark, d)).withColumn("p", F.round("p", 9))
    return benjamini_hochberg(c, "p", 0.25).select("sa", "sb", F.round("p_adjusted", 5).alias("p_adjusted"), "rejected")


@query(f"""WITH {CONC}, p AS (SELECT sa, least(1, 2 * least({BINOM.format(n='cc.n', k='cc.k', p='0.5')}, {BINOM.format(n='cc.n', k='(cc.n - cc.k)', p='0.5')})) AS p FROM cc), g AS (SELECT sa, count(*) AS k, -2 * sum(ln(greatest(p, 1e-300))) AS x FROM p GROUP BY 1)
SELECT sa, k, round(exp(-x / 2) * (SELECT sum(pow(x / 2, j) / gamma(j + 1)) FROM range(0, CAST(k AS BIGINT)) t(j)), 6) AS p FROM g""")
def cnv_fisher_combined(spark, d):
    c = concordance_p(concordances(spark, d))
    g = c.groupBy("sa").agg(F.count("*").alias("k"), (-2 * F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("x"))
    # closed form for an even number of degrees of freedom, as a fold over the terms
    tail = F.expr("aggregate(sequence(1, greatest(cast(k as int) - 1, 1)), named_struct('t', 1.0D, 's', 1.0D), (a, j) -> named_struct('t', a.t * (x / 2) / j, 's', a.s + if(j < k, a.t * (x / 2) / j, 0.0D)), a -> a.s)")
    return g.select("sa", "k", F.round(F.exp(-F.col("x") / 2) * tail, 6).alias("p"))


@query(f"WITH {PAIRS} SELECT sa, count(DISTINCT cb) AS categories FROM pr GROUP BY 1 HAVING count(DISTINCT cb) >= 2")
def cnv_cross_category(spark, d):
    return pairs(spark, d).groupBy("sa").agg(F.countDistinct("cb").alias("categories")).where("categories >= 2")


@query(f"WITH {CONC} SELECT sa AS a, sb AS b, round(k / n, 6) AS weight FROM cc WHERE k / n > 0.52")
def cnv_coincidence_graph(spark, d):
    return graph(spark, d).select("a", "b", F.round("weight", 6).alias("weight"))


def graph(spark, d):
    return concordances(spark, d).select(F.col("sa").alias("a"), F.col("sb").alias("b"), (F.col("k") / F.col("n")).alias("weight")).where("weight > 0.52")


def named(spark, d):
    return series(spark, d).select(F.col("signal").alias("node"), "category").distinct()


@query()
def cnv_convergence_cliques(spark, d):
    """Maximal cliques of three signals or more, of two categories or more."""
    found = cliques(graph(spark, d).select("a", "b"), 3, named(spark, d), 2)
    return found.select(F.array_join("members", "|").alias("members"), F.size("members").alias("size"))


@query()
def cnv_clique_score(spark, d):
    g = written(graph(spark, d).withColumn("direction", F.lit(1)), "graph")
    found = written(cliques(g.select("a", "b"), 3, named(spark, d), 2), "cliques")
    return scored(found, g, named(spark, d)).select(F.array_join("members", "|").alias("members"), "score")


@query(f"WITH {CONC} SELECT CAST(sign(sum(CASE WHEN k / n >= 0.5 THEN 1 ELSE -1 END * abs(k / n - 0.5))) AS INTEGER) AS direction, count(*) AS pairs FROM cc")
def cnv_clique_direction(spark, d):
    share = F.col("k") / F.col("n")
    vote = F.when(share >= 0.5, 1).otherwise(-1) * F.abs(share - 0.5)
    return concordances(spark, d).agg(F.signum(F.sum(vote)).cast("int").alias("direction"), F.count("*").alias("pairs"))


@query("""WITH z AS (SELECT signal, d, abs((value - avg(value) OVER w) / stddev_samp(value) OVER w) AS z FROM series WINDOW w AS (PARTITION BY signal)), n(node, signal, lo, hi) AS (VALUES ('a', 'flag.R', 0, 20), ('b', 'orders.BUILDING', 5, 40), ('c', 'priority.1-URGENT', 0, 60)),
m AS (SELECT node, max(z) AS z FROM n JOIN z ON z.signal = n.signal AND z.d BETWEEN DATE '1998-01-10' - hi AND DATE '1998-01-10' - lo GROUP BY 1) SELECT count(*) AS nodes, round(exp(avg(ln(greatest(z, 0.01)))), 5) AS score FROM m HAVING count(*) = 3""")
def cnv_chain_match(spark, d):
    nodes = spark.createDataFrame([("a", "flag.R", 0, 20), ("b", "orders.BUILDING", 5, 40), ("c", "priority.1-URGENT", 0, 60)], "node string, signal string, lo int, hi int")
    w = Window.partitionBy("signal")
    z = series(spark, d).withColumn("z", F.abs((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)))
    back = F.date_diff(F.lit("1998-01-10").cast("date"), F.col("d"))
    m = z.join(F.broadcast(nodes), "signal").where(back.between(F.col("lo"), F.col("hi"))).groupBy("node").agg(F.max("z").alias("z"))
    return m.agg(F.count("*").alias("nodes"), F.round(F.exp(F.avg(F.log(F.greatest("z", F.lit(0.01))))), 5).alias("score")).where("nodes = 3")


@query("""WITH a AS (SELECT brand, bars.d, close, row_number() OVER (PARTITION BY brand ORDER BY bars.d) AS n FROM bars), e AS (SELECT brand, max(n) AS n FROM a WHERE d <= DATE '1998-01-10' GROUP BY 1)
SELECT e.brand, round(y.close / x.close - 1, 6) AS ret, CASE WHEN y.close / x.close - 1 > 0.005 THEN 'up' WHEN y.close / x.close - 1 < -0.005 THEN 'down' ELSE 'flat' END AS outcome FROM e JOIN a x ON x.brand = e.brand AND x.n = e.n JOIN a y ON y.brand = e.brand AND y.n = e.n + 5""")
def cnv_chain_resolve(spark, d):
    from .views import bars

    b = bars(spark, d).withColumn("later", F.lead("close", 5).over(Window.partitionBy("brand").orderBy("d"))).where("d <= date '1998-01-10'")
    last = b.groupBy("brand").agg(F.max_by(F.struct("close", "later"), "d").alias("x")).where("x.later is not null")
    ret = F.col("x.later") / F.col("x.close") - 1
    return last.select("brand", F.round(ret, 6).alias("ret"), F.when(ret > 0.005, "up").when(ret < -0.005, "down").otherwise("flat").alias("outcome"))


@query()
def cnv_detect(spark, d):
    """The whole cycle: pair tests, Fisher, step-up control, graph, cliques."""
    tested = benjamini_hochberg(combined(spark, d), "p", 0.2)
    edges = tested.where("rejected").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    found = cliques(edges, 3, named(spark, d), 2)
    return found.select(F.array_join("members", "|").alias("members"), F.size("members").alias("size"))


@query("""WITH g AS (SELECT signal, CAST(DATE '1997-01-01' + CAST(i AS INTEGER) * 7 AS DATE) AS t FROM (SELECT DISTINCT signal FROM series), range(52) x(i)), a AS (SELECT g.signal, g.t, max(s.d) AS d FROM g LEFT JOIN series s ON s.signal = g.signal AND s.d <= g.t GROUP BY 1, 2)
SELECT a.signal, CAST(a.t AS VARCHAR) AS t, CASE WHEN a.t - a.d <= 3 THEN value END AS value FROM a LEFT JOIN series s ON s.signal = a.signal AND s.d = a.d""")
def cnv_locf_grid(spark, d):
    s = series(spark, d)
    weeks = spark.range(52).select(F.expr("date_add(date '1997-01-01', cast(id * 7 as int))").alias("t"))
    grid = s.select("signal").distinct().join(F.broadcast(weeks))  # 52 rows
    f = asof_join(grid, s, ["signal"], "t", "d", "value")
    return f.select("signal", F.col("t").cast("string").alias("t"), F.when(F.date_diff("t", F.col("found.ts")) <= 3, F.col("found.value")).alias("value"))


TEMPLATES = [("stress", 1, "returns", "^flag", 1, 0), ("stress", 2, "logistics", "nation", 0, 60), ("boom", 1, "demand", "^orders", 1, 0), ("boom", 2, "urgency", "URGENT", 0, 90), ("boom", 3, "logistics", "nation", 0, 120)]


TEMPLATE_SQL = """WITH tp(template, step, category, pattern, sign_, within_) AS (VALUES ('stress', 1, 'returns', '^flag', 1, 0), ('stress', 2, 'logistics', 'nation', 0, 60), ('boom', 1, 'demand', '^orders', 1, 0), ('boom', 2, 'urgency', 'URGENT', 0, 90), ('boom', 3, 'logistics', 'nation', 0, 120)),
z AS (SELECT signal, category, d, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM series WINDOW w AS (PARTITION BY signal)), e AS (SELECT signal, category, sign(z) AS dir, min(d) AS d FROM z WHERE abs(z) > 2.5 AND d >= DATE '1998-01-01' GROUP BY 1, 2, 3),
m AS (SELECT template, step, within_, e.d, row_number() OVER (PARTITION BY template, step ORDER BY e.d, signal) AS k FROM tp JOIN e ON e.category = tp.category AND regexp_matches(signal, pattern) AND (sign_ = 0 OR dir = sign_)),
f AS (SELECT template, step, within_, d FROM m WHERE k = 1), t AS (SELECT template, d AS trigger FROM f WHERE step = 1), n AS (SELECT template, count(*) AS steps FROM tp GROUP BY 1)"""
TEMPLATE_RESULT = """SELECT n.template, round(count(f.step) FILTER (WHERE f.step = 1 OR abs(f.d - t.trigger) <= within_) / any_value(steps), 6) AS match FROM n LEFT JOIN t ON t.template = n.template LEFT JOIN f ON f.template = n.template GROUP BY 1"""


@query(f"{TEMPLATE_SQL} {TEMPLATE_RESULT}")
def cnv_template_match(spark, d):
    """Steps of a template matched by the first event of a fitting category, name and direction, within days of the trigger."""
    rules = spark.createDataFrame(TEMPLATES, "template string, step int, cat string, pattern string, sign int, within int")
    w = Window.partitionBy("signal")
    z = series(spark, d).withColumn("z", F.round((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w), 6))
    e = z.where("abs(z) > 2.5 and d >= date '1998-01-01'").groupBy("signal", "category", F.signum("z").alias("dir")).agg(F.min("d").alias("d"))
    fits = (F.col("category") == F.col("cat")) & F.expr("signal rlike pattern") & ((F.col("sign") == 0) | (F.col("dir") == F.col("sign")))
    f = e.join(F.broadcast(rules), fits).groupBy("template", "step", "within").agg(F.min("d").alias("d"))
    t = f.where("step = 1").select("template", F.col("d").alias("trigger"))
    n = rules.groupBy("template").agg(F.count("*").alias("steps"))
    j = n.join(t, "template", "left").join(f, "template", "left")
    ok = (F.col("step") == 1) | (F.abs(F.date_diff("d", "trigger")) <= F.col("within"))
    return j.groupBy("template").agg(F.round(F.count_if(F.coalesce(ok, F.lit(False))) / F.first("steps"), 6).alias("match"))


@query(f"{TEMPLATE_SQL}, r AS ({TEMPLATE_RESULT}) SELECT template, match FROM r WHERE match >= 0.5 ORDER BY match DESC, template LIMIT 1")
def cnv_best_template(spark, d):
    return cnv_template_match(spark, d).where("match >= 0.5").orderBy(F.desc("match"), "template").limit(1)
