"""Structured Streaming forms of the stateful monitors.

Each function takes and returns a streaming (or static) DataFrame; watermarks
bound the state. `drain` runs a bounded stream to its end, for tests and queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import new_path


def file_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def dedupe(stream: DataFrame, keys: list[str], ts: str, horizon: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, keys: list[str], width: str, late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n", "mean")


def sliding(stream: DataFrame, ts: str, keys: list[str], width: str, slide: str, late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return w.agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n")


CUSUM_STATE = "s double"


def cusum(stream: DataFrame, key: str, ts: str, z: str, k: float = 0.5, h: float = 5.0, cap: float = 50.0) -> DataFrame:
    """The alerts of the cumulative sum, its state kept by key between batches. Within a batch rows are taken in time order."""

    def run(keys: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values([ts, "id"])
        out = []
        for t, i, x in zip(rows[ts], rows["id"], rows[z], strict=True):
            s = min(max(0.0, s + (x if x == x else 0.0) - k), cap)
            if s > h:
                out.append((keys[0], t, i, s))
                s = 0.0
        state.update((s,))
        yield pd.DataFrame(out, columns=["key", "ts", "id", "s"])

    kind = stream.schema[ts].dataType.simpleString()
    return stream.select(F.col(key).alias("key"), ts, "id", z).groupBy("key").applyInPandasWithState(run, f"key string, ts {kind}, id long, s double", CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a bounded stream, run to its end into Parquet in the shared folder."""
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream"), new_path(spark, "stream-marks")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
    else:  # the last batch holds the whole result
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def name() -> str:
    return f"s{uuid.uuid4().hex[:12]}"
