"""The keys of handled findings as a table that grows by week and is joined where it lies.

Earlier reports need not be aggregated again for each new one: their keys are appended once to a table in buckets by key. A report brings
its findings, which are few, into the same buckets and joins them there; the handled side is read and sorted, never shuffled.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .checks import KEY

BUCKETS = 64


def finding_key() -> Column:
    """The key of a finding as one text that no other key has: each part with its length, a missing one as ``-``."""
    parts = [F.col(k).cast("string") for k in KEY]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def open_handled(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The name of the table of handled keys in a folder, which is made if there is none. Its number of buckets is fixed when
    it is made and part of the folder's name; another one is an error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [m for f in (fs.listStatus(root) if fs.exists(root) else []) if (m := re.fullmatch(r"keys-(\d+)", f.getPath().getName()))]
    if any(int(m[1]) != buckets for m in made):
        raise ValueError(f"{path} has {[m[1] for m in made]} buckets, not {buckets}")
    name = f"handled_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (finding STRING) USING parquet CLUSTERED BY (finding) SORTED BY (finding) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path.rstrip('/')}/keys-{int(buckets)}'")
    return name


def add_handled(table: str, reports: DataFrame) -> None:
    """Append the keys of further reports; keys that occur twice in them are written once."""
    spark, buckets = reports.sparkSession, _buckets(reports.sparkSession, table)
    keys = reports.select(finding_key().alias("finding")).repartition(buckets, "finding").distinct()
    keys.write.insertInto(table)
    spark.catalog.refreshTable(table)


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def unhandled(found: DataFrame, table: str, wave: str | None = None, init_waves: Sequence[str] = ("00", "01"),
              drop_all_copies: bool = False) -> DataFrame:
    """The report of a wave, as ``checks.findings_report``, against a table of handled keys: distinct findings by content, without the
    handled ones unless the wave is an initial one.

    ``drop_all_copies`` also drops findings that occur more than once. Copies are combined before the exchange."""
    spark = found.sparkSession
    keyed = found.select(finding_key().alias("finding"), F.struct(*found.columns).alias("row"))
    first = wave in init_waves
    combined = keyed.groupBy("finding", F.pmod(F.xxhash64("row"), F.lit(16)).alias("part")).agg(  # a finding's copies in parts
        F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    once = (combined.repartition(_buckets(spark, table), "finding").groupBy("finding")
            .agg(F.sum("copies").alias("copies"), F.min("row").alias("row")))
    if drop_all_copies and not first:
        once = once.where("copies = 1")
    kept = once if first else once.join(spark.table(table), "finding", "left_anti")
    return kept.select("row.*").orderBy("content", "id", "no", "reason")
