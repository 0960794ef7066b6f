"""Reads and writes of the observation tables (Parquet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def given(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet the conditions whose argument isn't None: name, since_name, until_name or least_name."""
    for name, value in conditions.items():
        if value is None:
            continue
        if name.startswith("since_") or name.startswith("least_"):
            df = df.where(F.col(name[6:]) >= F.lit(value))
        elif name.startswith("until_"):
            df = df.where(F.col(name[6:]) <= F.lit(value))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def newest(df: DataFrame, ts: str, limit: int | None = None, tie: list[str] | None = None) -> DataFrame:
    out = df.orderBy(F.desc(ts), *[F.asc(c) for c in tie or []])
    return out.limit(limit) if limit is not None else out


def read_observations(obs: DataFrame, since=None, until=None, ts: str = "ts") -> DataFrame:
    return given(obs, **{f"since_{ts}": since, f"until_{ts}": until})


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the one with the largest version; of equal versions a row of new."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new to append: the first by order of each key that old doesn't have."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def delete_range(df: DataFrame, since, until, ts: str = "ts") -> DataFrame:
    """What a delete of [since, until) leaves; rows without a time stay."""
    return df.where(~F.coalesce((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)), F.lit(False)))


def append(df: DataFrame, path: str, ts: str = "ts", source: str = "source") -> None:
    """Append-only, partitioned by source and day, so reads of a source and a time range prune. Rebalancing splits a busy source's day over tasks."""
    df.withColumn("obs_date", F.to_date(ts)).hint("rebalance", source, "obs_date").write.mode("append").partitionBy(source, "obs_date").parquet(path)


def complete_pending(pending: DataFrame, outcomes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Completed rows, and what is still pending."""
    return pending.join(outcomes, key), pending.join(outcomes.select(key), key, "left_anti")


def with_state(pending: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Each pending row once, with its state: `completed` if outcomes, distinct by key, has it, else `pending`. One join, where `complete_pending` takes two."""
    done = outcomes.select(key, F.lit("completed").alias("state"))
    return pending.join(done, key, "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def messages(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
