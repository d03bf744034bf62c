"""Gaps between neighbouring times that stand in rows, one row per respondent and time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.small import materialize


def neighbours(df: DataFrame, who: str, time: str, ties: Sequence[str] = ()) -> DataFrame:
    """The rows with ``previous``: the row before of the same respondent by time and ``ties`` (a struct of both), NULL for the first one. Rows
    without a respondent or time have no neighbours and are left out.

    Rows are dealt out by ranges of respondent and time, so a respondent with half of all rows lies in many ranges. Within a range
    the row before is found by a window; the last row of each range, one row per partition, is handed to the next range."""
    order = [time, *ties]
    ranges = (df.where(F.col(f"`{who}`").isNotNull() & F.col(f"`{time}`").isNotNull())
              .repartitionByRange(*[F.col(f"`{c}`") for c in (who, *order)]).withColumn("__part", F.spark_partition_id()))
    placed = materialize(ranges, "time-ranges")  # where the ranges begin is drawn from a sample: it must not change between its readers
    here = F.struct(*[F.col(f"`{c}`") for c in order])
    last = placed.groupBy(F.col("__part").alias("__of")).agg(F.max(F.struct(F.col(f"`{who}`").alias("who"), here.alias("row"))).alias("last"))
    edges = last.select("__of", F.expr("lag(last) OVER (ORDER BY __of)").alias("__edge"))  # as many rows as there are partitions
    by = ", ".join(f"`{c}`" for c in order)
    within = placed.withColumn("previous", F.expr(f"lag(struct({by})) OVER (PARTITION BY `{who}`, __part ORDER BY {by})"))
    joined = within.join(F.broadcast(edges), F.col("__part") == F.col("__of"))
    from_edge = F.when(F.col("__edge.who") == F.col(f"`{who}`"), F.col("__edge.row"))
    return joined.withColumn("previous", F.coalesce("previous", from_edge)).drop("__part", "__of", "__edge")


def event_gaps(df: DataFrame, who: str, time: str, threshold_minutes: float = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The rows whose time lies more than the threshold after the row before of the same respondent, with ``previous`` and ``minutes``."""
    minutes = F.timestamp_diff("MICROSECOND", F.col(f"previous.`{time}`"), F.col(f"`{time}`")) / F.lit(6e7)
    return neighbours(df, who, time, ties).withColumn("minutes", minutes).where(F.col("minutes") > threshold_minutes)
