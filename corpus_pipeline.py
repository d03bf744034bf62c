"""A corpus cleaned stage by stage. Each stage is an operator of ``tallyloom.llm`` over all rows that the one before kept.

All stages but the last return the columns of their input; ``text`` and ``n_chars`` follow what a stage removes from a text.
Rows with one ``doc_id`` are one document: a stage keeps or drops them together. An empty table stays empty.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import decontaminate, jaccard, lines, pieces, quality
from tallyloom.llm.catalog import PIECE_MODEL
from tallyloom.llm.common import broadcast_below
from tallyloom.plans.small import materialize


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with the new text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)
           if "n_chars" in docs.columns else None}
    return changed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail."""
    return _with_text(docs, quality.keep_clean(docs), "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; one that keeps no word goes."""
    cleaned = lines.dedup_lines(docs, min_chars=1).where(r"n_removed = 0 or text rlike r'[\p{L}\p{N}]'")
    return _with_text(docs, cleaned, "text")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies."""
    near = jaccard.near_copies(docs)
    copies = near.where(~F.col("doc").eqNullSafe(F.col("class_id"))).select(F.col("doc").alias("__doc")).distinct()
    copies = broadcast_below(materialize(copies, "copies"))
    return docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_pieces`` of the documents left."""
    encoded = pieces.encode(docs, pieces.load_model(PIECE_MODEL))
    return encoded.select(F.col("doc").alias("doc_id"), "ids", F.size("ids").alias("n_pieces"))


STAGES: list[tuple[str, Callable]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination), ("piece_encoding", piece_encoding)]

#: Edit distances, minimum hashes and piece merges have no form in SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
