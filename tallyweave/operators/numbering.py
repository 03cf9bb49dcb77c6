"""Dense numbers over a whole table in an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import own_columns


def numbered(df: DataFrame, order: list[str], spill: Callable[[DataFrame], DataFrame], by: list[str] | None = None, name: str = "index") -> DataFrame:
    """df with its place in the order, from 1, in the whole table or within each value of by; nulls come first.

    Rows are dealt by range of (by, order), sorted in their partition and counted there; a number is the row's place in its partition plus the
    rows of its value in partitions before, summed over one row a partition and value. spill(df) writes the sorted rows to shared storage, so that
    they are dealt once. Rows that are equal in by and order get neighbouring numbers. An empty table stays empty.
    """
    by, kept = by or [], own_columns(df)
    keys = [*by, *(c for c in order if c not in by)]
    laid = spill(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_tw_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_tw_part", F.shiftright("_tw_at", 33))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_tw_n").over(group.orderBy("_tw_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = laid.groupBy(*by, "_tw_part").agg(F.min("_tw_at").alias("_tw_first"), F.count("*").alias("_tw_n"))
    parts = parts.withColumn("_tw_shift", F.coalesce(before, F.lit(0)) - F.col("_tw_first") + 1)
    parts = parts.select(*(F.col(c).alias(f"_tw_by{i}") for i, c in enumerate(by)), F.col("_tw_part").alias("_tw_p"), "_tw_shift")
    same = laid["_tw_part"] == parts["_tw_p"]
    for i, c in enumerate(by):
        same = same & laid[c].eqNullSafe(parts[f"_tw_by{i}"])
    return laid.join(parts, same).withColumn(name, F.col("_tw_at") + F.col("_tw_shift")).select(*(c for c in kept if c != name), name)
