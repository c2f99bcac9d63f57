"""Reading tables, keeping intermediate ones, and helpers for work inside tasks."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docsnap.session import filesystem, shared_folder

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; lazy results may read it until the session ends."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder: lost executors do not lose them."""
    place = work_folder(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def keep_lean(df: DataFrame, label: str) -> DataFrame:
    """As ``keep``, and the shuffle files behind the rows are deleted once they are written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return keep(df, label)
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def remembered(name: str, key, make: Callable):
    """What ``make`` gives for the key, kept in this process until anything else is asked for.

    Functions travel to Python workers by value, so module variables start anew with every task;
    this memory outlives them. It holds one thing, so that what one operator needed does not stay
    in a worker that has gone on to another.
    """
    memory = sys.modules.setdefault("docsnap_remembered", types.ModuleType("docsnap_remembered"))
    if getattr(memory, "held", None) != (name, key):
        memory.held = memory.thing = None
        memory.thing = make()
        memory.held = (name, key)
    return memory.thing


def release() -> None:
    """Gives memory that is free back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is derived from one at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def text_pieces(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a string column in pieces of about ``most_bytes``: first row, end row, their
    UTF-8 bytes end to end, and the row offsets in them. Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, from batches in which equal values are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if held and values[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = values[start]
    if held:
        yield pa.Table.from_batches(held)
    release()


def discard(kept: DataFrame) -> None:
    """Deletes a kept table that nothing will read again."""
    for place in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        files, target = filesystem(kept.sparkSession, place)
        files.delete(target, True)
