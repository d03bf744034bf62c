"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_below(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a narrow table whose rows were counted and are at most ``max_rows``; beyond
    that the frame as it is, joined by a shuffle. The rows of the result are the same either way."""
    return F.broadcast(df) if df.count() <= max_rows else df
