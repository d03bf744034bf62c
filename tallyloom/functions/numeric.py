"""Rounding, safe parsing and level labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def n_round(x: Column) -> Column:
    """Round half towards +infinity (``F.round`` sends -2.5 to -3; here it is -2)."""
    x = x.cast("double")
    return F.when(x - F.floor(x) < 0.5, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def safe_int(col: Column) -> Column:
    """Whole number or NULL; ``'12.0'`` and ``'x'`` are not whole-number text."""
    return col.try_cast("int")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def level_label(col: Column, data_type: T.DataType) -> Column:
    """Text label of a tabulated code: numbers truncate to whole numbers, text stays."""
    if isinstance(data_type, T.IntegralType) or not is_numeric(data_type):
        return col.cast("string")
    return col.cast("bigint").cast("string")
