"""Small tables and lineage cuts."""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "integer": pa.int32()}


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table held in the plan (a local relation). Its exact size is known to the optimizer,
    which then broadcasts it by itself when that is right."""
    fields = T._parse_datatype_string(schema).fields
    columns = zip(*rows) if rows else [[] for _ in fields]
    table = pa.table({f.name: pa.array(list(c), _ARROW[f.dataType.typeName()])
                      for f, c in zip(fields, columns)})
    return spark.createDataFrame(table)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``, the checkpoint folder of the session, or
    the warehouse. On a cluster a warehouse on the local disk is none, and an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    if re.match(r"file:|/", warehouse) and not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share: {warehouse} is local to a machine of {master}")
    return warehouse


_written: list[str] = []  # what materialize wrote for this driver


def clear_written(spark: SparkSession) -> int:
    """Delete the files of all frames that were materialized so far, which cannot be read after that; their number."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/tallyloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files, so a
    lost executor costs a re-read and not a recomputation. The files stay, as the result may be read any time, until
    :func:`clear_written`."""
    path = run_folder(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Like :func:`materialize`, for a frame that only the caller's block reads: its files go with the block."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def fence(df: DataFrame, col: str) -> DataFrame:
    """The same rows, for a costly array column that is about to be exploded. Explode makes the
    optimizer infer a filter on the array and copy the array's expression into it; an unpivot of
    one column stops that copy, so the expression runs once per row."""
    return df.unpivot([c for c in df.columns if c != col], [col], "__part", col).drop("__part")
