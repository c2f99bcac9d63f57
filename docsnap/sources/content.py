"""Contents of files, read where they are processed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.operators.extract import Extractor, PythonExtractor
from docsnap.schema import EXTRACTED
from docsnap.session import tasks_for

_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 1_000
_BYTES_PER_TASK = 512 * 1024 * 1024
_FILES_PER_TASK = 20_000
_PIECE_BYTES = 16 * 1024 * 1024
#: Bytes of the largest file that is taken as a whole; its text must fit in a row and in a worker.
MOST_BYTES = 512 * 1024 * 1024


def _opened(path: str):
    """A mounted file by its path, one of another storage by its URI."""
    if "://" not in path:
        return open(path, "rb")
    store, place = FileSystem.from_uri(path)
    return store.open_input_stream(place)


class FileTooLarge(OSError):
    """A file above the limit, which is not read to its end."""


def _whole(path: str, most: int) -> bytes:
    """The bytes of a file, read in pieces, so that one above the limit costs no more than the limit
    whatever size it was listed with."""
    pieces, size = [], 0
    with _opened(path) as handle:
        while piece := handle.read(min(_PIECE_BYTES, most + 1 - size)):
            pieces.append(piece)
            size += len(piece)
            if size > most:
                raise FileTooLarge(f"more than {most} bytes")
    return b"".join(pieces)


def _read(files: DataFrame, extractor: PythonExtractor | None, keep_data: bool) -> DataFrame:
    columns = files.columns
    added = [T.StructField("data", T.BinaryType())]
    added += EXTRACTED.fields if extractor else [T.StructField("read_error", T.StringType())]
    schema = T.StructType(files.schema.fields + added)

    most, length = MOST_BYTES, columns.index("length") if "length" in columns else None

    def load(row: tuple, at: int) -> tuple:
        try:
            if length is not None and (row[length] or 0) > most:
                raise FileTooLarge(f"more than {most} bytes")
            data = _whole(row[at], most)
        except (OSError, MemoryError, pa.ArrowException) as problem:
            error = f"{type(problem).__name__}: {problem}"
            return (*row, None, None, None, error) if extractor else (*row, None, error)
        if extractor is None:
            return *row, data, None
        return *row, data if keep_data else None, *extractor.one(data)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, size = schema.fieldNames(), [], 0
        for frame in frames:
            at = frame.columns.get_loc("path")
            for row in frame.itertuples(index=False, name=None):
                held.append(load(row, at))
                size += _weight(held[-1][len(columns) :])
                if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                    yield pd.DataFrame(held, columns=names, dtype=object)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names, dtype=object)
        if extractor is not None:
            extractor.close()

    return files.mapInPandas(read, schema)


def _weight(values: tuple) -> int:
    """Bytes and characters that were read or extracted, in lists and maps as well."""
    if isinstance(values, (bytes, str)):
        return len(values)
    if isinstance(values, dict):
        return _weight(tuple(values.values()))
    return sum(map(_weight, values)) if isinstance(values, (tuple, list)) else 0


def read_tasks(files: DataFrame) -> int:
    """Tasks to read the files with, by their number and their total ``length``."""
    load = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).first()
    by_bytes = -(-load["bytes"] // _BYTES_PER_TASK)
    spark = files.sparkSession
    return max(tasks_for(spark, load["files"], _FILES_PER_TASK), min(by_bytes, load["files"]))


def read_and_extract(
    files: DataFrame, extractor: Extractor, keep_data: bool, tasks: int | None = None
) -> DataFrame:
    """Open the files of ``path`` and add ``data, metadata, text, error``.

    The rows are dealt out evenly first: a comparison with a snapshot leaves few and uneven
    partitions. A Python extractor runs in the pass that reads, so bytes that no later step
    needs never leave the worker.
    """
    dealt = files.repartition(tasks or read_tasks(files))
    if isinstance(extractor, PythonExtractor):
        return _read(dealt, extractor, keep_data)
    extracted = extractor(_read(dealt, None, True))
    return extracted.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")
