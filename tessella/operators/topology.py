"""Shape of a window's points from their distances: persistence of components, its distance to a baseline, and the spectral gap.

All take windows by a column `g`, many at once; points of a window are few (named
instruments), windows as many as the data hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def correlation_distances(returns: DataFrame) -> DataFrame:
    """g, a, b, dist = sqrt(2 (1 - correlation)) of every two points of a window, both ways. returns: g, d, point, ret, one row for
    a point and day; a day without one counts as 0, and a flat point has correlation 0. From sums over shared days."""
    days = returns.groupBy("g").agg(F.countDistinct("d").alias("n"))
    own = returns.groupBy("g", "point").agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    side = lambda p, v: returns.select("g", "d", F.col("point").alias(p), F.col("ret").alias(v))
    shared = side("a", "x").join(side("b", "y"), ["g", "d"]).groupBy("g", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    part = lambda p: own.select("g", F.col("point").alias(p), F.col("s").alias(f"s{p}"), F.col("q").alias(f"q{p}"))
    every = part("a").join(part("b"), "g").where("a <> b").join(shared, ["g", "a", "b"], "left").join(days, "g")
    n = F.col("n")
    spread = lambda p: F.col(f"q{p}") - F.col(f"s{p}") * F.col(f"s{p}") / n
    both = F.sqrt(spread("a") * spread("b"))
    corr = F.when((spread("a") > 1e-18) & (spread("b") > 1e-18), (F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb") / n) / both).otherwise(0.0)
    return every.select("g", "a", "b", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - corr))).alias("dist"))


def persistence(distances: DataFrame) -> DataFrame:
    """g and deaths, the sorted distances at which a window's components merge: the edges of its minimum spanning tree.

    Boruvka's rounds over all windows at once: each component takes its nearest edge to another, and labels merge along
    the chosen edges; at least half of the components go each round. Ties go by the points' names, so no cycle is chosen.
    """
    edges = written(distances.where("a < b"), "distances")
    label = written(distances.select("g", F.col("a").alias("p"), F.col("a").alias("root")).distinct(), "labels")
    chosen = None
    while True:
        of = lambda p: label.select("g", F.col("p").alias(p), F.col("root").alias(f"root_{p}"))  # noqa: B023, E731
        across = written(edges.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"]).where("root_a <> root_b"), "across")
        key = F.struct("dist", "a", "b", "root_a", "root_b")
        ends = across.select("g", F.explode(F.array("root_a", "root_b")).alias("root"), key.alias("e"))
        nearest = written(ends.groupBy("g", "root").agg(F.min("e").alias("e")), "nearest")
        if not nearest.limit(1).count():
            break
        new = nearest.select("g", "e.dist", "e.a", "e.b").distinct()
        chosen = written(new if chosen is None else chosen.unionByName(new), "tree")
        # each component points to the one at the other end of its edge; of two that point to each other the smaller is the root
        other = F.when(F.col("e.root_a") == F.col("root"), F.col("e.root_b")).otherwise(F.col("e.root_a"))
        to = nearest.select("g", "root", other.alias("to"))
        back = to.select("g", F.col("root").alias("to"), F.col("to").alias("again"))
        to = written(to.join(back, ["g", "to"]).select("g", "root", F.when((F.col("again") == F.col("root")) & (F.col("root") < F.col("to")), F.col("root")).otherwise(F.col("to")).alias("to")), "merges")
        while True:  # the chains of pointers halve each time
            ahead = to.select("g", F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = written(to.join(ahead, ["g", "to"]).select("g", "root", "to", "further"), "merges")
            moved = jumped.where("to <> further").limit(1).count()
            to = jumped.select("g", "root", F.col("further").alias("to"))
            if not moved:
                break
        label = written(label.join(to, ["g", "root"], "left").select("g", "p", F.coalesce("to", "root").alias("root")), "labels")
    empty = distances.select("g").distinct().withColumn("none", F.lit(None).cast("double"))
    tree = empty if chosen is None else chosen.select("g", F.col("dist").alias("none"))
    return tree.groupBy("g").agg(F.sort_array(F.collect_list("none")).alias("deaths"))


def entropy(deaths: Column) -> Column:
    total = F.aggregate(deaths, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 1e-12, F.aggregate(deaths, F.lit(0.0), lambda s, x: s - F.when(x > 1e-12, x / total * F.log(x / total)).otherwise(0.0))).otherwise(0.0)


def matching_distance(a: Column, b: Column) -> Column:
    """The largest difference of two sorted diagrams, largest with largest; what one has more is matched to 0."""
    down = lambda x: F.sort_array(x, asc=False)
    gaps = F.zip_with(down(a), down(b), lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return F.coalesce(F.array_max(gaps), F.lit(0.0))


def spectral_gap(distances: DataFrame, epsilon: float | None = None, squarings: int = 9) -> DataFrame:
    """g and gap: the second smallest eigenvalue of the Laplacian of the graph of points nearer than epsilon, by default the
    median distance of the window.

    M = I - L / c with c twice the largest degree has the eigenvalues of L in reverse order; without its constant
    part, M^(2^squarings) is all but a multiple of the wanted vector's projection, so its largest column is that vector,
    and its Rayleigh quotient the eigenvalue. Each squaring is one join and one sum over all windows, scaled by the
    window's largest entry. A graph in pieces gives 0, as does one of less than three points.
    """
    limit = distances.groupBy("g").agg((F.percentile("dist", 0.5) if epsilon is None else F.lit(float(epsilon))).alias("limit"))
    pairs = written(distances.join(limit, "g").select("g", "a", "b", (F.col("dist") < F.col("limit")).cast("double").alias("near")), "near")
    degree = written(pairs.groupBy("g", "a").agg(F.sum("near").alias("degree")), "degrees")
    size = degree.groupBy("g").agg(F.count("*").alias("n"), (2 * F.max("degree")).alias("c"))
    laplace = pairs.select("g", "a", "b", (-F.col("near")).alias("l")).unionByName(degree.select("g", "a", F.col("a").alias("b"), F.col("degree").alias("l")))
    laplace = written(laplace, "laplace")
    scaled = size.where("n >= 3 and c > 0")
    m = laplace.join(scaled, "g").select("g", "a", "b", ((F.col("a") == F.col("b")).cast("double") - F.col("l") / F.col("c") - 1 / F.col("n")).alias("m"))
    for _ in range(squarings):
        right = m.select("g", F.col("a").alias("k"), F.col("b").alias("to"), F.col("m").alias("y"))
        square = written(m.select("g", "a", F.col("b").alias("k"), F.col("m").alias("x")).join(right, ["g", "k"]).groupBy("g", "a", "to").agg(F.sum(F.col("x") * F.col("y")).alias("m")), "square")
        largest = square.groupBy("g").agg(F.max(F.abs("m")).alias("top"))
        m = square.join(largest, "g").select("g", "a", F.col("to").alias("b"), (F.col("m") / F.greatest("top", F.lit(1e-300))).alias("m"))
    # the largest diagonal entry marks the largest column
    best = m.where("a = b").groupBy("g").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    v = written(m.join(best, ["g", "b"]).select("g", "a", F.col("m").alias("v")), "vector")
    lv = laplace.join(v.select("g", F.col("a").alias("b"), F.col("v").alias("w")), ["g", "b"]).groupBy("g", "a").agg(F.sum(F.col("l") * F.col("w")).alias("lv"))
    ratio = v.join(lv, ["g", "a"]).groupBy("g").agg((F.sum(F.col("v") * F.col("lv")) / F.sum(F.col("v") * F.col("v"))).alias("gap"))
    return size.join(ratio, "g", "left").select("g", F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0))).alias("gap"))
