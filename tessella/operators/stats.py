"""Statistical control and rank statistics as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05, groups: list[str] | None = None) -> DataFrame:
    """df with rank, adjusted p and rejected, by step-up over each group (or all rows).

    Equal p share the largest rank, so the result doesn't depend on the order of ties. The rows here are tests
    (pairs of signals, rules), one group of them to a task.
    """
    keys = groups or [F.lit(1).alias("_all")]
    part = Window.partitionBy(*[k if isinstance(k, str) else F.lit(1) for k in keys])
    m = F.count(p).over(part)
    rank = F.count(p).over(part.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raw = df.withColumn("bh_rank", rank).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * m / rank))
    adjusted = F.min("_raw").over(part.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= q).drop("_raw")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, buckets_per_unit: float = 1 / 64) -> DataFrame:
    """keys, n (the sum of the whole weights), mean and the interpolated quantile of value, each row counted weight times.

    Values are counted by bucket first; only the buckets that hold the two ranks around the quantile are then counted by
    value, so no group's distinct values are gathered. df is read twice.
    """
    bucket = F.floor(F.col(value) * buckets_per_unit)
    part = Window.partitionBy(*keys)
    past = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket.alias("_b")).agg(F.sum(weight).alias("_n"), F.sum(F.col(value) * F.col(weight)).alias("_s"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))).withColumn("n", F.sum("_n").over(part)).withColumn("mean", F.sum("_s").over(part) / F.col("n"))
    at = q * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    picked = written(counts.where((F.col("_before") <= high) & (F.col("_before") + F.col("_n") > low)), "buckets")
    exact = df.withColumn("_b", bucket).join(F.broadcast(picked.select(*keys, "_b", "_before", "n", "mean")), [*keys, "_b"])  # one or two buckets of each group
    exact = exact.groupBy(*keys, value).agg(F.sum(weight).alias("_c"), *[F.first(c).alias(c) for c in ("_before", "n", "mean")])
    upto = F.min("_before").over(part) + F.sum("_c").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = exact.withColumn("_upto", upto).groupBy(*keys, "n", "mean").agg(*[F.min(F.when(F.col("_upto") > r, F.col(value))).alias(c) for c, r in (("_low", low), ("_high", high))])
    return ranked.select(*keys, "n", "mean", (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - low)).alias("quantile"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 within keys; ties share their mean."""
    up = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    return df.withColumn(name, up + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def rolling_corr(x: str, y: str, w) -> Column:
    """Pearson correlation over a frame from window sums: null when either side is flat."""
    n, sx, sy = F.count(x).over(w), F.sum(x).over(w), F.sum(y).over(w)
    sxx, syy, sxy = F.sum(F.col(x) * F.col(x)).over(w), F.sum(F.col(y) * F.col(y)).over(w), F.sum(F.col(x) * F.col(y)).over(w)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy))
