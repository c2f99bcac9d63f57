"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsnap.session import materialised, shuffle_width


_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row below


def with_position(df: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """Add ``position``, counted from 0 in the order of ``keys``, which must be unique.

    The rows are range-partitioned, sorted and numbered within their partition, then written
    once, so that the numbers and the partition sizes come from the same split. Only the
    sizes, one row per partition, are added up in order.
    """
    width = slices or shuffle_width(df.sparkSession)
    sliced = materialised(
        df.repartitionByRange(width, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition: never more than ``width``.
    return (
        sliced.join(F.broadcast(starts), "_slice")
        .withColumn("position", F.col("_start") + within)
        .drop("_at", "_slice", "_start")
    )
