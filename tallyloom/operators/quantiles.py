"""Exact quantiles. Columns of few distinct values, as codes and most weights are, take part in an ordinary aggregate; longer ones are
sorted by ranges over the cluster, so that no task holds the values of a column."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.small import scratch

FEW = 1_000_000  # distinct values that one aggregation buffer holds


def columns_of_few_values(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns with at most ``FEW`` distinct values, by an estimate in one pass."""
    if not cols:
        return []
    counts = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if counts[i] <= FEW]


def spread_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles by linear interpolation of columns of any number of values; NULL is left out.

    Equal values are counted, the counts sorted by ranges and summed per range. These sums, a row for each range and column, tell
    in which ranges the wanted ranks lie; only those are read again."""
    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(f"{i}") for i, c in enumerate(cols)])
    values = narrow.unpivot([], list(narrow.columns), "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    ranges = values.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    with scratch(ranges, "quantiles") as held:
        sums = held.groupBy("column", "part").agg(F.sum("n").alias("n"))
        starts = sums.select("column", "part", "n", F.expr(
            "sum(n) OVER (PARTITION BY column ORDER BY part) - n").alias("before"), F.expr("sum(n) OVER (PARTITION BY column)").alias("total"))
        low, high = [], []
        for p in probs:
            place = F.lit(float(p)) * (F.col("total") - 1)
            low.append(F.floor(place).cast("long"))
            high.append(F.ceil(place).cast("long"))
        wanted = starts.withColumn("ranks", F.array_distinct(F.array(*low, *high))).withColumn(
            "ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).where(F.size("ranks") > 0)
        picked = wanted.select(F.col("column").alias("of"), F.col("part").alias("of_part"), "before", "total", "ranks")
        here = held.join(F.broadcast(picked), (F.col("column") == F.col("of")) & (F.col("part") == F.col("of_part")))
        upto = here.withColumn("upto", F.col("before") + F.expr("sum(n) OVER (PARTITION BY column, part ORDER BY value)"))
        hits = upto.select("column", "value", "total", F.explode(F.filter(
            "ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
        found = {(r["column"], r["rank"]): (r["value"], r["total"]) for r in hits.collect()}  # two ranks a quantile at most
    totals = {column: total for (column, _), (_, total) in found.items()}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            if str(i) not in totals:
                out[c].append(None)
                continue
            place = p * (totals[str(i)] - 1)
            a, b = (found[str(i), k][0] for k in (math.floor(place), math.ceil(place)))
            out[c].append(a + (place - math.floor(place)) * (b - a))
    return out


def quantile_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    """The quantiles of every column, to be used in an aggregate of ``df``."""
    few = set(columns_of_few_values(df, cols))
    many = spread_quantiles(df, [c for c in cols if c not in few], probs) if len(few) < len(set(cols)) else {}

    def of(c: str) -> list[Column]:
        if c in few:  # one aggregate for all probabilities
            every = F.percentile(F.col(f"`{c}`").cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
            return [every[k] for k in range(len(probs))]
        return [F.lit(q).cast("double") for q in many[c]]

    return {c: of(c) for c in cols}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; NULL is left out."""
    made = quantile_columns(df, cols, probs)
    row = df.agg(F.lit(0).alias("none"), *[q.alias(f"q{i}_{k}") for i, c in enumerate(cols) for k, q in enumerate(made[c])]).first()
    return {c: [row[f"q{i}_{k}"] for k in range(len(probs))] for i, c in enumerate(cols)}
