"""Helpers for operators whose work inside a task is Python on Arrow batches."""
from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

MAX_ROWS, MAX_BYTES = 1000, 16 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker. Batches
    change how rows travel, never which rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BYTES))


def give_back() -> None:
    """Return freed memory to the system. Worker processes outlive their tasks, and several wait beside the running ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
