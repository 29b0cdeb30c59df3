"""Ranks inside groups of any size, as prefix sums over ranges of values.

Counts of distinct values are cut into ranges of bounded size. A range's total goes to the ranges after it in the same
group, and inside a range the counts are summed in order: no task holds more than one range, whatever a group holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

RANGE = 1 << 18  #: distinct values in a range, about


def with_below(counts: DataFrame, by: str, value: str, n: str = "n") -> DataFrame:
    """counts (by, value, n, ...), a row per value of a group, with ``below``: the sum of n over the group's smaller values."""
    counts = written(counts, "counts")
    ranges = -(-counts.count() // RANGE)
    if ranges <= 1:  # all groups together are one range
        inside = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("below", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    cut = counts.repartitionByRange(ranges, by, value).withColumn("range", F.spark_partition_id())
    cut = written(cut, "ranges")  # the ranges are drawn by a sample: fixed from here on
    totals = cut.groupBy(by, "range").agg(F.sum(n).alias("total"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ahead = totals.select(by, "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range", by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return summed.join(ahead, [by, "range"]).withColumn("below", F.col("ahead") + F.col("own")).drop("ahead", "own", "range")
