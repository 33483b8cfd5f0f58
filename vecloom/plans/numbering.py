"""Dense global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def number_rows(df: DataFrame, order: list[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    """Add ``name``: 0-based position in the global ``order`` (plus ``start``).

    Range sort, then an offset per partition. The sorted rows are stored first, so partition
    numbers and positions come from one and the same run.
    """
    ordered = stored(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id()),
        "ordered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # one row per partition
        .drop("_n")
    )
    in_part = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), 33)
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, in_part + F.col("_offset") + F.lit(start))
        .drop("_part", "_mono", "_offset")
    )



def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Add ``name``: sum of ``amount`` over all rows before this one in the global ``order``."""
    ordered = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.sum(amount).alias("_s"))
        .withColumn("_offset", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")  # one row per partition
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_in") + F.col("_offset")).drop("_part", "_in", "_offset")
    )
