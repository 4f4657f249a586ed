"""Consecutive ids and running sums in a stated order, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def consecutive(df: DataFrame, order: list[str], name: str = "item_id", start: int = 0) -> DataFrame:
    """df with `name`: start, start + 1, ... by `order`.

    Rows are dealt into ranges of the order; each is ranked alone and shifted by the sizes of those before it.
    """
    ranged = df.repartitionByRange(*(F.col(c).asc_nulls_last() for c in order)).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", before.alias("_before"))  # one row for each range
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    got = ranged.withColumn("_rank", rank).join(F.broadcast(shifts), "_range")
    return got.withColumn(name, (F.col("_before") + F.col("_rank") - 1 + start).cast("long")).drop("_range", "_rank", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """df with `name`: the sum of `value` over all rows that come before by `order`."""
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.sum(value).alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", upto.alias("_before"))  # one row for each range
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = ranged.withColumn("_own", own).join(F.broadcast(shifts), "_range")
    return got.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
