"""Session defaults and the folder that driver and executors share.

Operators that need a result more than once, or want its lineage short, write
it to that folder. Results are lazy, so only the caller knows when they are no
longer read: `clear(spark)` then deletes all that the session has written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, and only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; the master is {master}")
    if app not in _fallback:
        folder = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[app] = "file://" + folder
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what this session has written to the shared folder; results that still read it can't be read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: short lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition that `parts` aims at.
PART_ROWS = 250_000


def parts(df: DataFrame) -> int:
    """So many partitions that one holds about PART_ROWS rows, and a task for each core at least: adaptive execution puts a shuffle
    together to few partitions that grow with the table, but leaves numbers that are asked for. Parquet files tell their counts."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
