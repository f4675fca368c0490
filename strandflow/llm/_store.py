"""Intermediate tables, the session's partitions, and the memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

from strandflow.operators.store import discard, materialize, new_dir, shared_dir, write

__all__ = ["discard", "give_back", "materialize", "new_dir", "shared_dir", "shuffle_partitions", "write"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system, not kept for its next task: later stages without Python need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
