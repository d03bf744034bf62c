"""Text helpers."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters a whitespace strip removes, ideographic space included.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
              "         　")


def _is_space(character: Column) -> Column:
    return F.contains(F.lit(WHITESPACE), character)


def strip(col: Column) -> Column:
    """Without white space at both ends. Trimming by a set of characters is slow, so it is left to values that begin or end with one."""
    return F.when(_is_space(F.left(col, F.lit(1))) | _is_space(F.right(col, F.lit(1))), F.btrim(col, F.lit(WHITESPACE))).otherwise(col)


def is_blank(col: Column, trimmed: bool = True) -> Column:
    """NULL or empty; with ``trimmed`` whitespace-only counts as empty too. Never NULL."""
    text = col.cast("string")
    blank = text == ""
    if trimmed:
        blank = blank | (_is_space(F.left(text, F.lit(1))) & (F.btrim(text, F.lit(WHITESPACE)) == ""))
    return F.coalesce(blank, F.lit(True))


def shown(col: Column) -> Column:
    """A value as it is printed in a finding; NULL prints as ``nan``."""
    return F.coalesce(col.cast("string"), F.lit("nan"))


def natural_key(name: str) -> list:
    """Sort key that orders ``t2`` before ``t10``."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p)
            for p in re.split(r"(\d+)", name) if p]


def normalise_line_breaks(col: Column) -> Column:
    return F.regexp_replace(col, "\r+\n", "\n")
