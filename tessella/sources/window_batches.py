"""A streaming source of files that each hold one time window, as feeds publish them every quarter of an hour.

A file's name begins with its window (any text that sorts by time). The newest
window is held back, as it may not be complete; a file that arrives late, out of
order, is read when it comes. An offset is the newest arrival listed so far and
the files held back then, so it stays small, each file is read once, and a
restart goes on where the last run ended. Files are put in place by a rename and
don't change; those younger than `grace` seconds wait for the next listing, so
that clocks of writers may differ by that much.

    spark.dataSource.register(WindowBatches)
    spark.readStream.format("window_batches").schema("...").option("path", folder).load()
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, grace: float, schema: StructType):
        self.path, self.grace, self.columns = path, grace, schema

    def files(self) -> list[tuple[int, str]]:
        """(arrival in nanoseconds, name) of all settled files, by arrival."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        until = time.time_ns() - int(self.grace * 1e9)
        found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet")]
        return sorted((f.mtime_ns, f.base_name) for f in found if f.mtime_ns <= until)

    def initialOffset(self) -> dict:
        return {"arrival": [0, ""], "held": []}

    def latestOffset(self) -> dict:
        files = self.files()
        if not files:
            return self.initialOffset()
        window = lambda name: name.split(".")[0].split("-part")[0]
        newest = max(window(n) for _, n in files)
        return {"arrival": list(files[-1]), "held": sorted(n for _, n in files if window(n) == newest)}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        came = [n for at, n in self.files() if tuple(start["arrival"]) < (at, n) <= tuple(end["arrival"])]
        take = sorted((set(came) | set(start["held"])) - set(end["held"]))
        return [OneFile(f"{self.path}/{n}") for n in take]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        path = partition.value
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        kind = to_arrow_schema(self.columns)
        for batch in pq.ParquetFile(store.open_input_file(root)).iter_batches(columns=kind.names):
            yield from pa.Table.from_batches([batch]).select(kind.names).cast(kind).to_batches()

    def commit(self, end: dict) -> None:
        pass


class WindowBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "window_batches"

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"].rstrip("/"), float(self.options.get("grace", 1)), schema)


def put_in_place(spark: SparkSession, partitioned: str, target: str) -> None:
    """Moves the files of a table partitioned by its window (w=...) to one folder, each named after its window, by renames."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(partitioned).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(target))
    for folder in store.listStatus(path(partitioned)):
        window = folder.getPath().getName().removeprefix("w=")
        if folder.isDirectory():
            for i, f in enumerate(x for x in store.listStatus(folder.getPath()) if x.getPath().getName().endswith(".parquet")):
                store.rename(f.getPath(), path(f"{target}/{window}-part{i}.parquet"))
