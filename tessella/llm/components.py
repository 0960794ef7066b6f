"""Connected components of a graph held in DataFrames.

Alternating large-star and small-star rounds. Each round is two groupings of the
edges by vertex; the edges are written to the shared folder after each, so a
lost executor costs one round at most. Nothing but the count of changed edges
comes to the driver.

A vertex with very many neighbours is handled without gathering them: the
smallest neighbour is an aggregate with map-side combine, written and then
joined back to the edges, so that the join shuffles both sides anew and Spark
can split the vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large-star links the larger neighbours of a vertex to its smallest; small-star the smaller ones."""
    sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    if large:
        out = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = sides.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """u, root for every vertex with an edge, roots included; root is the smallest vertex of the component."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(now, "edges")
    before = print_of(now)
    for _ in range(rounds):
        now = written(_star(written(_star(now, large=True), "stars"), large=False), "edges")
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
