"""Graph steps as joins: components, cliques, breadth-first search."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts, written


def components(edges: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """node, root (the smallest node of its component). Labels spread to neighbours and jump to the label of their label,
    so long chains shorten by half in a round; each round is written to the shared folder."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "both-ways")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    for _ in range(most):
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = spread.select(F.col("node").alias("at"), F.col("root").alias("further"))
        after = written(spread.join(jump, F.col("root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        changed = after.where("old <> root").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"the labels did not settle in {most} rounds")


#: Passes of `block_components` over a block's cells.
PASSES = 6


def block_components(rows: DataFrame, node: str, block: str, one: str, other: str) -> DataFrame:
    """block, one, other, root, last and further: the smallest and the largest node that rows of one block reach, where rows
    that are equal in one or in the other column are linked.

    Rows are first counted together to cells, one for each block and pair of values, so a block costs no more than these
    however many rows it has. Cells are dealt by block once, and labels spread by windows within it, without a shuffle. A
    chain too long for PASSES is left in parts, of which each has a root that links it to `further`; elsewhere further is the root.
    """
    cells = written(rows.groupBy(block, one, other).agg(F.min(node).alias("root"), F.max(node).alias("last")), "cells")
    now = cells.repartition(parts(cells), block)
    for x in [one, other] * PASSES:
        w = Window.partitionBy(block, x)
        now = now.withColumns({"root": F.min("root").over(w), "last": F.max("last").over(w)})
    return written(now.withColumn("further", F.min("root").over(Window.partitionBy(block, one))), "cells")


def peeled(edges: DataFrame) -> DataFrame:
    """node and layer: each round takes away the nodes of at most twice the mean degree, at least half of those left, so the
    rounds are few, and a node has at most four times as many neighbours in its own and later layers as the densest part has edges a node."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    left = both = written(both.union(both.select("y", "x")), "both-ways")
    layers = both.select(F.col("x").alias("node")).distinct()
    gone = None
    for layer in count():
        degrees = written(left.groupBy("x").agg(F.count("*").alias("degree")), "degrees")
        mean = degrees.agg(F.avg("degree")).first()[0]
        if mean is None:
            break
        now = degrees.where(F.col("degree") <= 2 * mean).select("x")
        gone = now.withColumn("layer", F.lit(layer)) if gone is None else gone.union(now.withColumn("layer", F.lit(layer)))
        left = written(left.join(now, "x", "left_anti").join(now.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y"), "left")
    # nodes whose neighbours have all gone have none in later layers
    return layers.withColumn("layer", F.lit(0)) if gone is None else layers.join(gone, F.col("node") == F.col("x"), "left").select("node", F.coalesce("layer", F.lit(layer)).alias("layer"))


def grown_cliques(inner: list[tuple], outer: list[tuple], least: int, category: dict, own, min_categories: int) -> list[list]:
    """Maximal cliques of one node: inner are the edges among its later neighbours, outer those from earlier to later neighbours.

    Bron and Kerbosch's enumeration with a pivot, over bit sets; a branch that can't reach the least members or categories ends.
    """
    names = sorted({x for e in inner for x in e} | {p for _, p in outer})
    at = {x: i for i, x in enumerate(names)}
    earlier = sorted({x for x, _ in outer})
    before = {x: len(names) + i for i, x in enumerate(earlier)}
    near = [0] * (len(names) + len(earlier))
    for x, y in inner:
        near[at[x]] |= 1 << at[y]
        near[at[y]] |= 1 << at[x]
    for x, y in outer:
        near[before[x]] |= 1 << at[y]
        near[at[y]] |= 1 << before[x]
    members = (1 << len(names)) - 1
    bits = lambda m: (i for i in range(m.bit_length()) if m >> i & 1)
    out = []

    def grow(r: list[int], p: int, x: int) -> None:
        if 1 + len(r) + p.bit_count() < least or (min_categories > 1 and len({category[own], *(category[names[i]] for i in (*r, *bits(p)))}) < min_categories):
            return
        if not p:
            if not x:
                out.append(sorted([own, *(names[i] for i in r)]))
            return
        pivot = max(bits(p | x), key=lambda u: (p & near[u]).bit_count())
        for v in bits(p & ~near[pivot]):
            grow([*r, v], p & near[v], x & near[v])
            p, x = p & ~(1 << v), x | 1 << v

    grow([], members, sum(1 << i for i in before.values()))
    return out


def cliques(edges: DataFrame, least: int = 3, categories: DataFrame | None = None, min_categories: int = 1) -> DataFrame:
    """Maximal cliques (edges a < b) of at least `least` members, and of min_categories by categories (node, category), as sorted arrays.

    Edges point from nodes that `peeled` takes away first to later ones, so few leave a node however many it has. Each
    triangle goes to its first node as an inner edge and to its second as an outer one; a node's group then holds all
    that tells which cliques begin with it and whether an earlier node would extend them. Cliques of two are the edges without a triangle.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rank = lambda c: peel.select(F.col("node").alias(c), F.struct("layer", "node").alias(f"rank_{c}"))
    peel = written(peeled(e), "layers")
    both = e.join(rank("a"), "a").join(rank("b"), "b")
    swap = F.col("rank_a") > F.col("rank_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    to = written(both.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("rank_b", "rank_a").alias("rank")), "pointed")
    second = to.select("u", F.col("v").alias("w"), F.col("rank").alias("last"))
    wedges = to.join(second, "u").where("rank < last")
    triangles = written(wedges.join(to.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]).select("u", "v", "w"), "triangles")
    kind = e.schema["a"].dataType.simpleString()
    found = None
    if least <= 2:
        sides = [triangles.select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("u", "v"), ("u", "w"), ("v", "w"))]
        sides = sides[0].union(sides[1]).union(sides[2])
        alone = e.join(sides.union(sides.select("b", "a")).distinct(), ["a", "b"], "left_anti").select(F.sort_array(F.array("a", "b")).alias("members"))
        if categories is not None and min_categories > 1:
            of = lambda i: F.element_at("members", i)
            c1, c2 = (categories.select(F.col("node").alias(f"n{i}"), F.col("category").alias(f"c{i}")) for i in (1, 2))
            alone = alone.join(c1, of(1) == F.col("n1")).join(c2, of(2) == F.col("n2")).where(F.lit(min_categories <= 2) & (F.col("c1") != F.col("c2"))).select("members")
        found = alone
    rows = triangles.select(F.col("u").alias("own"), F.lit(True).alias("inner"), F.col("v").alias("x"), F.col("w").alias("y"))
    rows = rows.union(triangles.select(F.col("v").alias("own"), F.lit(False).alias("inner"), F.col("u").alias("x"), F.col("w").alias("y")))
    labelled = categories is not None and min_categories > 1
    if labelled:
        for c in ("own", "x", "y"):
            rows = rows.join(categories.select(F.col("node").alias(c), F.col("category").alias(f"{c}_category")), c, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].iloc[0]
        category = {n: k for c in ("own", "x", "y") for n, k in zip(pdf[c], pdf[f"{c}_category"], strict=True)} if labelled else {}
        side = lambda m: list(zip(pdf["x"][m], pdf["y"][m], strict=True))
        got = grown_cliques(side(pdf["inner"]), side(~pdf["inner"]), max(3, least), category, own, min_categories if labelled else 1)
        return pd.DataFrame({"members": pd.Series(got, dtype=object)})

    grown = rows.groupBy("own").applyInPandas(run, f"members array<{kind}>")
    return grown if found is None else found.union(grown)


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hops from the nearest start node (a column node) along undirected edges a, b, up to depth."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node", F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        new = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = written(new.select("node", F.lit(hop).alias("hops")), f"hop-{hop}")
        seen = seen.unionByName(front)
    return seen
