"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows of a part, where their number is known.
ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: While this is set, Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCK, _WRITERS, _BEFORE = threading.Lock(), {}, {}


@contextmanager
def _files_deleted(spark: SparkSession) -> Iterator[None]:
    """The setting holds from the first of a session's writers to its last, whatever threads these are in."""
    key = id(spark._jsparkSession)
    with _LOCK:
        if not _WRITERS.get(key):
            _BEFORE[key] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS[key] = _WRITERS.get(key, 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[key] -= 1
            if not _WRITERS[key]:
                before = _BEFORE.pop(key)
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str, *by: str) -> None:
    """Write df as Parquet, in folders by the columns named. What has been written needs its shuffles no longer, so their files go at once."""
    with _files_deleted(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_dir(df.sparkSession, what)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df of so many rows by the columns, in as many parts as it needs, so that a task's memory doesn't follow the input: Spark alone puts parts together by their compressed bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *by)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote. Nothing that is read from it may be evaluated afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
