"""Prefix sums over dense ids without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one range; a range is a window of its own, and ranges are summed before the shuffle.
RANGE = 65_536


def prefix_sum(rows: DataFrame, by: str, value: str, out: str, size: int = RANGE, per: tuple[str, ...] = ()) -> DataFrame:
    """rows with `out`: the sum of `value` over rows of smaller `by`, within each `per`. `by` is an id that is unique there."""
    ranged = rows.withColumn("__range", F.floor(F.col(by) / size))
    sums = ranged.groupBy(*per, "__range").agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*per, "__range", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*per, "__range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(before, [*per, "__range"]).withColumn(out, (F.col("__before") + F.col("__within")).cast("bigint")).drop("__range", "__before", "__within")


def place(rows: DataFrame, per: tuple[str, ...], by: str, out: str, size: int = RANGE) -> DataFrame:
    """rows with `out`: how many rows of the same `per` have a smaller `by`, an id. A key of any number of rows is counted in
    ranges of `by` first, so no window holds more than `size` of them."""
    return prefix_sum(rows.withColumn("__one", F.lit(1)), by, "__one", out, size, per).drop("__one")
