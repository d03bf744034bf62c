"""Looking up single answers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.transcode import transcode_lossy


def query(df: DataFrame, idn, item: str | Sequence[str], col: str = "id") -> DataFrame:
    """The ``item`` columns of the rows where ``col`` = ``idn``."""
    items = [item] if isinstance(item, str) else list(item)
    return df.filter(F.col(f"`{col}`") == F.lit(idn)).select(*[F.col(f"`{i}`") for i in items])


def find_literal(df: DataFrame, col: str, literal: str = "?", key: str = "id") -> DataFrame:
    """Keys of the rows whose text contains ``literal`` (``?`` marks encoding damage)."""
    return df.filter(F.contains(F.col(f"`{col}`"), F.lit(literal))).select(key)


def multi_search(df: DataFrame, pairs: DataFrame, encoding: str | None = None) -> DataFrame:
    """The value, as text, of each (id, item) pair; NULL where there is none, one row per match.

    ``df`` is scanned for the asked columns only; which they are is at most one line per column of ``df``. One join
    by id, whose sides adaptive execution sizes, finds the rows, and the item picks the column.
    """
    asked = pairs.filter(F.col("item").isin(df.columns)).select("item").distinct()
    items = [r["item"] for r in asked.collect()]
    if not items:
        out = pairs.withColumn("value", F.lit(None).cast("string"))
    else:
        rows = df.select(F.col("id").alias("__id"), *[F.col(f"`{i}`").cast("string").alias(f"__v{n}") for n, i in enumerate(items)])
        value = F.coalesce(*[F.when(F.col("item") == i, F.col(f"__v{n}")) for n, i in enumerate(items)])
        out = (pairs.join(rows, (F.col("id") == F.col("__id")) & F.col("item").isin(items), "left")
               .select(*pairs.columns, value.alias("value")))
    if encoding is not None:
        out = out.withColumn(f"value_{encoding}", transcode_lossy(F.col("value"), encoding))
    return out


def _with_bins(ranges: DataFrame) -> DataFrame:
    """Each range in the bins that it meets: bins as wide as the next power of two, so it meets two at most, whatever its width."""
    bits = F.least(F.coalesce(F.length(F.bin(F.try_subtract(F.col("__hi"), F.col("__lo")))), F.lit(63)), F.lit(63)).alias("__bits")
    leveled = ranges.select("*", bits)
    first, last = (F.expr(f"shiftright(__{end}, __bits)") for end in ("lo", "hi"))
    return leveled.withColumn("__bin", F.explode(F.array_distinct(F.array(first, last))))


def range_lookup(df: DataFrame, col: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``df`` with the further columns of ``ranges`` where ``lo`` <= ``col`` <= ``hi`` (whole numbers): NULL without a match, a row for each of
    several. A range without both ends, or with its ends the wrong way round, matches nothing.

    Every range lies in the one or two bins of its own width, and every different value looks into one bin of each width that
    occurs (63 at most), so they meet by equality. Values that repeat are looked up once."""
    payload = [c for c in ranges.columns if c not in (lo, hi)]
    clash = [c for c in payload if c in df.columns]
    if clash:
        raise ValueError(f"columns of both tables: {clash}")
    given = ranges.select(F.col(f"`{lo}`").cast("bigint").alias("__lo"), F.col(f"`{hi}`").cast("bigint").alias("__hi"),
                          *[F.col(f"`{c}`") for c in payload]).where("__lo <= __hi")
    binned = _with_bins(given)
    widths = sorted(r[0] for r in binned.select("__bits").distinct().collect())  # 63 at most
    value = F.col(f"`{col}`").cast("bigint")
    asked = (df.select(value.alias("__value")).where("__value IS NOT NULL").distinct()
             .select("__value", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")).alias("__width"))
             .withColumn("__place", F.expr("shiftright(__value, __width)")))
    met = (asked.join(binned, (F.col("__width") == F.col("__bits")) & (F.col("__place") == F.col("__bin")))
           .where("__value BETWEEN __lo AND __hi").select("__value", *[F.col(f"`{c}`") for c in payload]))
    joined = df.join(met, value == F.col("__value"), "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns], *[met[f"`{c}`"] for c in payload])
