"""Three-layer missing data: NULL, user-missing codes and reserved negative codes."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float column. Run once at ingest: Spark treats NaN as a value
    (``NaN = NaN``, ``NaN > 10``, and one NaN poisons a sum)."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats
                       else F.col(f"`{c}`") for c in df.columns])


def typed_codes(data_type: T.DataType, codes: Iterable) -> list:
    """The codes that can equal a value of the type: a number never equals a text, as in a data frame."""
    text = isinstance(data_type, T.StringType)
    return [c for c in codes if c is not None and isinstance(c, str) == text]


def is_in(col: Column, codes: Iterable) -> Column:
    """Membership that is FALSE, not NULL, for a NULL value."""
    codes = list(codes)
    return F.coalesce(col.isin(codes), F.lit(False)) if codes else F.lit(False)


def not_equal(col: Column, value) -> Column:
    """``!=`` where NULL differs from every value (SQL would answer NULL)."""
    return ~col.eqNullSafe(F.lit(value))


def exclude_codes(df: DataFrame, col: str, codes: Sequence) -> DataFrame:
    """Drop the listed codes but keep NULL."""
    codes, c = typed_codes(df.schema[col].dataType, codes), F.col(f"`{col}`")
    return df.filter(c.isNull() | ~c.isin(codes)) if codes else df


def drop_missing(df: DataFrame, col: str, codes: Sequence = ()) -> DataFrame:
    """Drop the listed codes and NULL."""
    c = F.col(f"`{col}`")
    return df.filter(c.isNotNull() & ~is_in(c, typed_codes(df.schema[col].dataType, codes)))


def fill_missing_code(df: DataFrame, cols: Sequence[str], code: int = 99) -> DataFrame:
    """NULL -> ``code`` in the named columns, keeping each column's type."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(code).cast(types[c]))
                           for c in cols})


def sum_columns(df: DataFrame, new_col_name: str, sum_cols: Sequence[str]) -> DataFrame:
    """Row-wise sum with NULL as 0."""
    total = F.lit(0)
    for c in sum_cols:
        total = total + F.coalesce(F.col(f"`{c}`"), F.lit(0))
    return df.withColumn(new_col_name, total)
