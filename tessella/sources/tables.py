"""Keyed writes to a partitioned Parquet table: only the partitions that a change touches are written again.

A change is computed from the touched partitions and staged whole in the shared
folder before anything of the table is replaced; dynamic partition overwrite
then swaps just those partitions, and one left without rows is taken away. All
changes are idempotent: after a failure the same change is run again. Large
partitions are split over tasks and small ones put together by adaptive
rebalancing, so a partition with a third of all rows is no single task.

A key has to hold the partition columns; else a newer row could lie in another
partition than the one that it replaces, and that is an error.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_path, written
from . import store


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, parts: list[str], schema: StructType):
        self.spark, self.path, self.parts, self.schema = spark, path, parts, schema

    @classmethod
    def create(cls, df: DataFrame, parts: list[str], path: str | None = None) -> PartitionedTable:
        path = path or new_path(df.sparkSession, "table")
        df.hint("rebalance", *parts).write.partitionBy(*parts).parquet(path)
        order = [f for f in df.schema.fields if f.name not in parts] + [df.schema[p] for p in parts]
        return cls(df.sparkSession, path, parts, StructType(order))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def within(self, rows: DataFrame, touched: DataFrame, how: str = "left_semi") -> DataFrame:
        """Rows of the touched partitions; a null partition is one like any other."""
        names = touched.select(*[F.col(p).alias(f"_touched_{p}") for p in self.parts])
        return rows.join(names, reduce(and_, [F.col(p).eqNullSafe(F.col(f"_touched_{p}")) for p in self.parts]), how)

    def replace(self, touched: DataFrame, result: DataFrame) -> None:
        """The touched partitions (distinct values of the partition columns) hold `result` afterwards, all others the files they have."""
        touched = written(touched, "touched")
        staged = written(result.select(*self.schema.names).hint("rebalance", *self.parts), "staged")
        empty = self.within(touched, staged.select(*self.parts).distinct(), "left_anti")
        folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
        gone = [r.folder for r in self.within(self.read().select(*self.parts, folder.alias("folder")), empty).select("folder").distinct().collect()]  # a name for each emptied partition
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)
        for name in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, new: DataFrame, keys: list[str], version: str, valid: Column | None = None) -> None:
        """Per key the row with the largest version, of equal ones a row of new. Rows that aren't valid change nothing."""
        if not set(self.parts) <= set(keys):
            raise ValueError(f"the keys {keys} have to hold the partition columns {self.parts}")
        new = written(new.select(*self.schema.names) if valid is None else new.where(valid).select(*self.schema.names), "new")
        touched = new.select(*self.parts).distinct()
        self.replace(touched, store.upsert(self.within(self.read(), touched), new, keys, version))

    def delete(self, condition: Column) -> int:
        """Takes the rows away for which the condition is true; how many they were."""
        found = self.read().where(condition)
        touched = written(found.groupBy(*self.parts).agg(F.count("*").alias("_rows")), "touched")
        n = touched.agg(F.sum("_rows")).first()[0] or 0
        if n:
            self.replace(touched.select(*self.parts), self.within(self.read(), touched).where(~F.coalesce(condition, F.lit(False))))
        return n

    def update(self, condition: Column, **changes: Column) -> int:
        """Sets columns, not those of the partitions, of the rows for which the condition is true; how many they were."""
        if set(changes) & set(self.parts):
            raise ValueError(f"{sorted(set(changes) & set(self.parts))} are columns of the partitions")
        touched = written(self.read().where(condition).groupBy(*self.parts).agg(F.count("*").alias("_rows")), "touched")
        n = touched.agg(F.sum("_rows")).first()[0] or 0
        if n:
            true = F.coalesce(condition, F.lit(False))
            rows = self.within(self.read(), touched)
            kinds = {f.name: f.dataType for f in self.schema.fields}
            self.replace(touched.select(*self.parts), rows.select(*[F.when(true, changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in self.schema.names]))
        return n
