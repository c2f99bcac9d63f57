"""Bulk batches limited by count and by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.operators.position import with_position
from docsnap.session import materialised, shuffle_width

_ENTRIES = "slice long, rows long, exits array<int>, counts array<int>"


def next_starts(sizes: np.ndarray, bulk_size: int, byte_size: int) -> np.ndarray:
    """For each row as the first of a batch, the row that begins the next one.

    A batch closes once it holds enough rows or bytes, checked after each row.
    """
    totals = np.concatenate(([0], np.cumsum(sizes)))
    by_bytes = np.searchsorted(totals, totals[:-1] + byte_size)
    first = np.arange(len(sizes))
    return np.minimum(np.maximum(by_bytes, first + 1), first + bulk_size)


def walks(following: np.ndarray, rows: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """From each possible first row of a slice: where the batches leave it, and how many began.

    The exit is counted in rows behind the slice.
    """
    at, began = np.arange(entries), np.zeros(entries, np.int64)
    while (inside := at < rows).any():
        began[inside] += 1
        at[inside] = following[at[inside]]
    return at - rows, began


def bulk_batches(
    ops: DataFrame, keys: list[str], bulk_size: int, byte_size: int, slice_rows: int = 100_000
) -> DataFrame:
    """Add ``position`` and ``batch`` to rows with ``bytes``, in the order of ``keys``.

    Closing by bytes is sequential, but a batch never spans more than ``bulk_size`` rows. So the
    ordered rows are cut into slices; each finds, for every row that may be the first of a batch in it
    (one of its first ``bulk_size``), where the last batch leaves it for the next slice. These small
    maps are followed from slice to slice, which tells where each really begins, and then all
    slices number their rows at once. The size of a slice does not change the result. Pass
    narrow rows: sizes, not bodies.
    """
    slice_rows = max(slice_rows, bulk_size)
    placed = materialised(
        with_position(ops, keys).withColumn("slice", F.floor(F.col("position") / slice_rows).cast("bigint"))
    )
    width = shuffle_width(ops.sparkSession)
    # The first rows of a slice also close the last batches of the one before.
    ahead = placed.filter(F.col("position") % slice_rows < bulk_size).withColumn("slice", F.col("slice") - 1)
    sizes = placed.select("slice", "position", "bytes").unionByName(
        ahead.filter("slice >= 0").select("slice", "position", "bytes")
    )

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, frame in _slices(frames):
            inside = int((frame["position"] // slice_rows == number).sum())
            following = next_starts(frame["bytes"].to_numpy(), bulk_size, byte_size)
            exits, counts = walks(following, inside, min(bulk_size, inside))
            yield pd.DataFrame({"slice": [number], "rows": [inside], "exits": [exits.tolist()], "counts": [counts.tolist()]})

    maps = (
        sizes.repartition(width, "slice").sortWithinPartitions("slice", "position").mapInPandas(follow, _ENTRIES)
    )

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry = batch = 0
        for frame in frames:
            out = []
            for number, rows, exits, counts in frame.itertuples(index=False, name=None):
                out.append((number, entry, batch))
                if entry < rows:
                    entry, batch = exits[entry], batch + counts[entry]
                else:
                    entry -= rows
            yield pd.DataFrame(out, columns=["slice", "entry", "first"])

    # One small row per slice of many rows passes through this task, and it keeps two numbers.
    entries = maps.repartition(1).sortWithinPartitions("slice").mapInPandas(chain, "slice long, entry long, first long")
    dealt = (
        placed.join(materialised(entries), "slice")
        .repartition(width, "slice")
        .sortWithinPartitions("slice", "position")
    )

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, frame in _slices(frames):
            following = next_starts(frame["bytes"].to_numpy(), bulk_size, byte_size)
            begins = np.zeros(len(frame), np.int64)
            at = int(frame["entry"].iloc[0])
            while at < len(frame):
                begins[at] = 1
                at = following[at]
            frame["batch"] = frame["first"].iloc[0] - 1 + np.cumsum(begins)
            yield frame[schema.fieldNames()]

    schema = T.StructType(placed.drop("slice").schema.fields + [T.StructField("batch", T.LongType())])
    return dealt.mapInPandas(number, schema)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each slice, from frames in which they are neighbours."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for number, part in frame.groupby("slice", sort=True):
            if held and held[0]["slice"].iloc[0] != number:
                yield held[0]["slice"].iloc[0], pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0]["slice"].iloc[0], pd.concat(held, ignore_index=True)
