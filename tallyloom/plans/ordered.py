"""Ordered rules: the first that matches decides."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

UNMAPPED = -90


def first_match(rules: Sequence[tuple[Column, object]], otherwise=UNMAPPED) -> Column:
    """``CASE WHEN`` over (condition, result); a NULL condition does not match."""
    chain = F
    for condition, result in rules:
        chain = chain.when(condition, result if isinstance(result, Column) else F.lit(result))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def code_map(col: Column, table: Mapping[object, Sequence[int]]) -> list[tuple[Column, object]]:
    """Rules from {result: [codes]}."""
    return [(col.isin(list(codes)), result) for result, codes in table.items()]
