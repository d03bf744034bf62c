"""Population targets: (variable, category, proportion)."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import level_label
from .small import literal_table

SCHEMA = "variable string, category string, proportion double"


def category_text(category) -> str:
    """The label of a category as the data shows it: a whole number has no decimals."""
    whole = isinstance(category, float) and category.is_integer()
    return str(int(category) if whole else category)


def target_table(spark: SparkSession, targets) -> DataFrame:
    """Targets as a frame with text categories; accepts a frame or an iterable of triples."""
    if isinstance(targets, DataFrame):
        category = level_label(F.col("category"), targets.schema["category"].dataType)
        return targets.select(F.col("variable").cast("string").alias("variable"),
                              category.alias("category"),
                              F.col("proportion").cast("double").alias("proportion"))
    return literal_table(spark, [(str(v), category_text(c), float(p)) for v, c, p in targets], SCHEMA)


def target_lists(targets) -> dict[str, dict[str, float]]:
    """Targets by variable, in order of first appearance. The lines of a frame have no order of their own: they are
    taken by its column ``position``, without one by variable and category. Targets are report settings, a few
    lines per variable; respondent data never comes this way."""
    if isinstance(targets, DataFrame):
        by = ["position"] if "position" in targets.columns else ["variable", "category"]
        rows: Iterable = target_table(targets.sparkSession, targets.orderBy(*by)).collect()
    else:
        rows = [(str(v), category_text(c), float(p)) for v, c, p in targets]
    out: dict[str, dict[str, float]] = {}
    for variable, category, proportion in rows:
        out.setdefault(variable, {})[category] = proportion
    return out
