"""Writers. All write in parallel from the executors."""
from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.checks import answer_times, time_gap_report
from .readers import mounted


_FINDING = ["survey", "no", "id", "content", "reason", "reply", "note"]
_CSV = {"header": True, "escape": '"'}


def _by_wave(df: DataFrame, path: str, fmt: str) -> None:
    """Partitions of a survey and wave replace those of an earlier run and leave the others alone."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_code", "wave")
    (writer.options(**_CSV) if fmt == "csv" else writer).format(fmt).save(path)


def write_findings(found: DataFrame, path: str, survey_code: str, fmt: str = "parquet") -> None:
    """Findings, partitioned by survey and wave; a wave that is written again replaces its findings. Rebalancing keeps the
    files few and splits a wave that holds most of the findings."""
    rows = found.select(*_FINDING, F.lit(survey_code).alias("survey_code"), "wave")
    _by_wave(rows.hint("rebalance", F.col("wave")), path, fmt)


def write_gap_tables(df: DataFrame, path: str, survey_code: str, wave: str, threshold_minutes: float = 10,
                     fmt: str = "parquet") -> None:
    """The gap report (``ansTime_check``) and the full time table (``ansTime_data``) of a survey and wave."""
    for name, table in (("ansTime_check", time_gap_report(df, threshold_minutes)), ("ansTime_data", answer_times(df))):
        _by_wave(table.withColumns({"survey_code": F.lit(survey_code), "wave": F.lit(wave)}), f"{path.rstrip('/')}/{name}", fmt)


def write_weight_tables(tables: DataFrame, path: str, fmt: str = "parquet",
                        mode: str = "overwrite") -> None:
    """Weighted and unweighted margin tables, one folder each."""
    tables.write.mode(mode).partitionBy("mode").format(fmt).save(path)


def write_codebook(book: DataFrame, path: str, mode: str = "overwrite") -> None:
    book.write.mode(mode).parquet(path)


def write_text_files(texts: DataFrame, path: str, per_folder: int = 5000) -> None:
    """A new folder with a file for every row of ``text``, closed by a line break; a null text is a line break alone. Rows are spread over all tasks. In
    a mounted folder each task writes folders of its own, ``part=<task>-<number>``, in an order that a repeated task keeps; other
    file systems take Spark's writer, which needs milliseconds a file."""
    parts, root = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), mounted(texts.sparkSession, path)
    spread = texts.select("text").repartition(parts)
    if root is None:
        return spread.write.option("maxRecordsPerFile", 1).text(path)
    os.makedirs(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                folder = f"{root}/part={task}-{count // per_folder}"
                if count % per_folder == 0:
                    os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/part-{task:05d}-{count}.txt", "wb") as f:
                    f.write((text or b"") + b"\n")
                count += 1
        yield pa.record_batch([pa.array([count], pa.int64())], ["files"])

    (spread.sortWithinPartitions("text").select(F.col("text").cast("binary").alias("text"))
     .mapInArrow(write, "files bigint").agg(F.sum("files")).collect())


def write_clustered(df: DataFrame, path: str, *keys: str, mode: str = "overwrite", row_group_mb: int = 32) -> None:
    """A table for point lookups: sorted by ``keys`` over all files, so that the bounds of files and row groups tell most lookups by the first
    key apart, and with a Bloom filter on every key, which does so for the further ones. Filters reach both when the table is read."""
    writer = (df.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
              .write.mode(mode).option("parquet.block.size", row_group_mb * 1024 * 1024).option("parquet.bloom.filter.adaptive.enabled", True))
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", True)
    writer.parquet(path)
