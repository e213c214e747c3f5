"""Exact positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemark.session import materialise


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds `position` (from 1) of every row in its group by `order`, and `group_size`.

    Rows are ranged by the order columns into blocks of like size, whatever their values are, and counted per block;
    the position is the count of the group's earlier blocks plus the rank inside the own block. A group holding a third of all
    rows is ranked by as many tasks as there are blocks, and only its block counts meet in one place.
    """
    blocked = materialise(rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), "ranged")
    counts = blocked.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(per_group).alias("group_size"))
    rank = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    placed = blocked.withColumn("_rank", rank).join(offsets, [*group, "_block"])
    return placed.withColumn("position", F.col("_before") + F.col("_rank")).drop("_block", "_before", "_rank")


def running_totals(rows: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `amount` over the rows of a group from its first by `order` to this one; rows that tie in the order must not.

    Blocks as in `positions`: a group is summed by as many tasks as there are blocks, and only the blocks' sums meet in one place.
    """
    blocked = materialise(rows.repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id()), "ranged-amounts")
    sums = blocked.groupBy(*group, "_block").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sums.select(*group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")), "block-amounts")
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn("_inside", F.sum(amount).over(inside)).join(offsets, [*group, "_block"])
    return summed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")
