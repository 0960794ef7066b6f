"""Change, drift and dependence. Recursions run per series in a group map: many series, each of bounded length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting the argument above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def run_lengths(x: np.ndarray, hazard: float = 250.0, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Online change-point posterior with a Normal-inverse-gamma prior: expected run length and P(run = 0 or 1) at each point.

    Run lengths up to `most` are kept, which bounds the work of a point: in a stretch without a change of over `most`
    points the mass of longer runs is left out and the rest scaled to one, so the expected run length levels off there.
    """
    mean, sd = float(np.mean(x[:10])), float(np.std(x) + 1e-9)
    mu, kappa, alpha, beta = np.array([mean]), np.ones(1), np.ones(1), np.array([sd * sd])
    p = np.ones(1)
    expected, fresh = np.zeros(len(x)), np.zeros(len(x))
    for t, v in enumerate(x):
        df, scale = 2 * alpha, np.sqrt(beta * (kappa + 1) / (alpha * kappa))
        logp = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * np.log(df * math.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(((v - mu) / scale) ** 2 / df)
        like = p * np.exp(logp)
        grown = np.concatenate([[like.sum() / hazard], like * (1 - 1 / hazard)])[:most]
        p = grown / max(grown.sum(), 1e-300)
        new_beta = beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))
        mu, kappa, alpha, beta = (np.concatenate([[a], b])[:most] for a, b in ((mean, (kappa * mu + v) / (kappa + 1)), (1.0, kappa + 1), (1.0, alpha + 0.5), (sd * sd, new_beta)))
        expected[t], fresh[t] = float((p * np.arange(len(p))).sum()), float(p[:2].sum())
    return expected, fresh


def change_points(df: DataFrame, key: str, order: str, value: str, hazard: float = 250.0, drop: float = 0.5, least: float = 10.0) -> DataFrame:
    """key, order, expected run length, change: the expected run length fell below `drop` of one of at least `least`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        e, _ = run_lengths(pdf["v"].to_numpy(float), hazard)
        before = np.concatenate([[0.0], e[:-1]])
        return pd.DataFrame({"key": pdf["key"], "o": pdf["o"], "run_length": np.round(e, 6), "change": (before >= least) & (e < drop * before)})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where("v is not null")
    return rows.groupBy("key").applyInPandas(run, f"key string, o {rows.schema['o'].dataType.simpleString()}, run_length double, change boolean")


def wasserstein(a: Column, b: Column) -> Column:
    """W1 of two arrays: the area between their distribution functions, over the sorted values of both."""
    grid = F.array_sort(F.concat(a, b))
    below = lambda xs, x: F.size(F.filter(xs, lambda y: y <= x)) / F.size(xs)

    def area(i: Column) -> Column:
        x = F.element_at(grid, i)
        return F.abs(below(a, x) - below(b, x)) * (F.element_at(grid, i + 1) - x)

    steps = F.when(F.size(grid) > 1, F.sequence(F.lit(1), F.size(grid) - 1))
    return F.coalesce(F.aggregate(F.transform(steps, area), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def sample_distances(rows: DataFrame, keys: list[str], value: str, in_a: Column, in_b: Column, buckets: int = 64) -> DataFrame:
    """keys and w1, the area between the distribution functions of two samples of a key's rows, which may overlap.

    Equal values are counted first. A key's values are then dealt into buckets by rough quantiles; running sums go within
    buckets, on top of the buckets' totals, so the work is linear and a key with very many values is no single task. Null
    values are left out; a key of which either sample is empty has no row.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(one(in_a).alias("a"), one(in_b).alias("b")).where("a > 0 or b > 0")
    counts = written(counts, "counts")
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    total = counts.groupBy(*keys).agg(F.percentile_approx("x", shares, 1000).alias("cuts"), F.sum("a").alias("na"), F.sum("b").alias("nb")).where("na > 0 and nb > 0")
    dealt = written(counts.join(total, keys).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts"), "dealt")
    by_key = Window.partitionBy(*keys).orderBy("bucket")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("least"))
    sums = written(sums.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("sa", "sb")], F.lead("least").over(by_key).alias("following")), "buckets")
    within = Window.partitionBy(*keys, "bucket").orderBy("x")
    up = lambda c: F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"s{c}_before")
    gap = F.coalesce(F.lead("x").over(within), F.col("following")) - F.col("x")
    steps = dealt.join(sums, [*keys, "bucket"]).select(*keys, (F.abs(up("a") / F.col("na") - up("b") / F.col("nb")) * gap).alias("area"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("w1"))


def hmm_labels(x: np.ndarray, states: int = 2, rounds: int = 25) -> np.ndarray:
    """Gaussian hidden Markov labels by EM from quantile starts, states in order of their mean."""
    n = len(x)
    mu = np.quantile(x, (np.arange(states) + 0.5) / states)
    var = np.full(states, x.var() + 1e-6)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    start = np.full(states, 1 / states)
    gamma = np.full((n, states), 1 / states)
    for _ in range(rounds):
        b = np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        f, c = np.zeros((n, states)), np.zeros(n)
        f[0] = start * b[0]
        c[0] = f[0].sum()
        f[0] /= c[0]
        for t in range(1, n):
            f[t] = f[t - 1] @ move * b[t]
            c[t] = f[t].sum()
            f[t] /= c[t]
        g = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            g[t] = move @ (b[t + 1] * g[t + 1]) / c[t + 1]
        gamma = f * g
        pair = move * (f[:-1].T @ (b[1:] * g[1:] / c[1:, None]))
        move = pair / pair.sum(1, keepdims=True)
        start = gamma[0] / gamma[0].sum()
        weight = gamma.sum(0) + 1e-12
        mu = (gamma * x[:, None]).sum(0) / weight
        var = (gamma * (x[:, None] - mu) ** 2).sum(0) / weight + 1e-9
    order = np.argsort(np.argsort(mu))
    return order[gamma.argmax(1)]


def per_series(df: DataFrame, key: str, order: str, value: str, schema: str, f) -> DataFrame:
    """f(key, values in order) -> DataFrame for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        return f(pdf["key"].iloc[0], pdf["v"].to_numpy(float))

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where("v is not null")
    return rows.groupBy("key").applyInPandas(run, schema)
