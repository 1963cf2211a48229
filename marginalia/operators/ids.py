"""Ids for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import by_shuffle, stored


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in their group, in the given order, which leaves no ties.

    Rows are by_shuffle into ranges of (group, order), which are stored; a place is the number of the
    group's rows in the ranges before and the number inside. No group is sorted by one task.
    """
    ranged = stored(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, "__part").agg(F.count("*").alias("c"))  # a row a group and range
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    return ranged.join(by_shuffle(starts), [*group, "__part"]).withColumn(name, F.col("__start") + nth - 1).drop("__part", "__start")


def numbered(rows: DataFrame, order: list[str], taken: DataFrame) -> DataFrame:
    """``rows`` with an ``id``: they follow the largest id of ``taken``, without gaps, in the given order.

    Ids come in two levels: ranges of rows first, then a number inside each range. The ranges are
    stored before they are used, so that both levels see the same ones.
    """
    fresh = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "new-rows")
    inside = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = inside.groupBy("__part").agg(F.count("*").alias("c")).select("__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    out = inside.join(starts, "__part").join(F.broadcast(top))  # one row is broadcast
    return out.withColumn("id", F.col("__top") + F.col("__start") + F.col("__n")).drop("__part", "__n", "__start", "__top")
