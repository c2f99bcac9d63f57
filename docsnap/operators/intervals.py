"""Points next to intervals, by one sweep over sorted borders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsnap.session import materialised, shuffle_width


def interval_borders(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """``_at`` and ``_step``: how many more intervals are open from there on.

    Intervals that end before they begin, or begin nowhere, have none; one without an end stays open.
    """
    real = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    both = real.select(F.col(start).alias("_at"), F.lit(1).alias("_step")).unionByName(
        real.filter(F.col(end).isNotNull()).select(F.col(end).alias("_at"), F.lit(-1).alias("_step"))
    )
    return both.groupBy("_at").agg(F.sum("_step").alias("_step")).filter("_step <> 0")


def with_open_intervals(
    points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, slices: int | None = None
) -> DataFrame:
    """Add ``open_intervals``, how many intervals (start included, end not) hold the point.

    Borders and points are range-partitioned in one order, borders first where they coincide, and
    summed up along it. What is open where a partition begins follows from the sums of those before
    it, one number each. Points at one moment are told apart by a hash of their row, so that many of
    them are not one task's work. Each point moves once, and nothing depends on how long intervals are.
    """
    width = slices or shuffle_width(points.sparkSession)
    columns = [F.col(f"`{c}`") for c in points.columns]
    # A column of its own for the row, so that no name clashes.
    moved = points.select(
        F.struct(*columns).alias("_row"), F.col(at).alias("_at"), F.lit(0).cast("long").alias("_step"),
        F.lit(1).alias("_kind"), F.xxhash64(*columns).alias("_spread"),
    )
    borders = interval_borders(intervals, start, end).withColumns({"_kind": F.lit(0), "_spread": F.lit(0).cast("long")})
    order = ["_at", "_kind", "_spread"]
    sliced = (
        moved.unionByName(borders, allowMissingColumns=True)
        .repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_slice": F.spark_partition_id(), "_open": F.lit(0).cast("long")})
    )

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            steps = np.cumsum(batch["_step"].to_numpy()) + total
            total = int(steps[-1]) if len(steps) else total
            yield batch.set_column(batch.schema.get_field_index("_open"), "_open", pa.array(steps))

    swept = materialised(sliced.mapInArrow(sweep, sliced.schema))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        swept.groupBy("_slice")
        .agg(F.sum("_step").alias("_sum"))
        .select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    )
    # One row per partition: never more than ``width``.
    return (
        swept.filter("_kind = 1")
        .join(F.broadcast(carried), "_slice")
        .select("_row.*", (F.col("_open") + F.col("_carried")).alias("open_intervals"))
    )
