"""Import of a snapshot kept as a JSON object of path to mtime, however its lines run.

The file is cut into byte ranges. A range first counts its quotes; the parity of all before it tells
whether it begins within a string, so it knows which commas part entries. An entry belongs to the
range that holds the comma (or brace) in front of it, and is read on behind the range's end.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsnap.schema import SNAPSHOT
from docsnap.session import filesystem, materialised

logger = logging.getLogger(__name__)

RANGE_BYTES = 16 * 1024 * 1024
_BLOCK = 1024 * 1024
_QUOTE, _ESCAPE, _COMMA, _OPEN, _CLOSE = b'"\\,{}'


def json_snapshot(spark: SparkSession, location: str, range_bytes: int | None = None) -> DataFrame:
    """``path, mtime`` of the file; nothing where it is missing or damaged. Of a path that comes twice, one
    entry stays. Ranges are of ``RANGE_BYTES`` unless told otherwise."""
    nothing = spark.createDataFrame([], SNAPSHOT)
    files, target = filesystem(spark, location)
    if not files.exists(target):
        return nothing
    status = files.getFileStatus(target)
    uri, size = status.getPath().toString(), status.getLen()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    entries = materialised(_entries(spark, uri, size, range_bytes))
    check = entries.agg(
        F.count_if("outside").alias("outside"), F.count_if(F.expr("path is not null and mtime is null")).alias("damaged")
    ).first()
    if size == 0 or (check["outside"], check["damaged"]) != (0, 0):
        logger.warning("could not read the snapshot %s: starting from an empty one", location)
        return nothing
    return entries.filter("path is not null").groupBy("path").agg(F.max("mtime").alias("mtime"))


def _entries(spark: SparkSession, uri: str, size: int, range_bytes: int | None = None) -> DataFrame:
    """Rows of ``path, mtime``; without mtime where an entry is damaged, ``outside`` where the object is."""
    width = range_bytes or RANGE_BYTES
    parts = max(1, -(-size // width))

    def quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with _opened(uri) as handle:
                counts = [
                    sum(int(_marks(block, escaped)[0].sum()) for block, escaped in _blocks(handle, n * width, min(size, (n + 1) * width)))
                    for n in batch["id"]
                ]
            yield pd.DataFrame({"id": batch["id"], "quotes": counts})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, inside in zip(batch["id"], batch["inside"], strict=True):
                with _opened(uri) as handle:
                    rows = list(_of_range(handle, int(n) * width, width, size, bool(inside)))
                yield pd.DataFrame(rows, columns=["path", "mtime", "outside"], dtype=object).astype({"mtime": "float64", "outside": bool})

    ranges = spark.range(0, -(-size // width), 1, parts)
    counted = materialised(ranges.mapInPandas(quotes, "id long, quotes long"))
    # One row per range: a thousandth of a thousandth of the file.
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    parity = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False)))
    dealt = parity.repartition(parts, "id")
    return dealt.mapInPandas(read, "path string, mtime double, outside boolean")


def _opened(uri: str):
    files, place = FileSystem.from_uri(uri)
    return files.open_input_file(place)


def _blocks(handle, low: int, high: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The bytes in blocks, and whether the first of each is escaped by backslashes before it."""
    escaped = _escaped_at(handle, low)
    handle.seek(low)
    while low < high:
        block = np.frombuffer(handle.read(min(_BLOCK, high - low)), np.uint8)
        if not len(block):
            return
        yield block, escaped
        low += len(block)
        run = len(block) - 1 - np.flatnonzero(np.append(True, block != _ESCAPE))[-1] + 1
        escaped = bool((run + (escaped if run == len(block) else 0)) % 2)


def _escaped_at(handle, place: int) -> bool:
    run = 0
    while run < place:
        step = min(64, place - run)
        handle.seek(place - run - step)
        piece = handle.read(step)
        here = len(piece) - len(piece.rstrip(b"\\"))
        run += here
        if here < step:
            break
    return run % 2 == 1


def _marks(block: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where quotes stand that are not escaped, and how many there are up to each byte."""
    at = np.arange(len(block))
    last = np.maximum.accumulate(np.where(block != _ESCAPE, at, -1))
    run = at - 1 - np.append(-1, last[:-1])
    # A run from the beginning goes on from before, if that leaves its first byte escaped.
    run = run + (escaped & (run == at))
    quotes = (block == _QUOTE) & (run % 2 == 0)
    return quotes, np.cumsum(quotes)


def _of_range(handle, low: int, width: int, size: int, inside: bool) -> Iterator[tuple]:
    """The entries whose comma or brace lies in the range that begins at ``low``."""
    high, place = min(size, low + width), low
    held: bytes | None = None  # what has been read of entries, from the first that begins here
    for block, escaped in _blocks(handle, low, size):
        _, total = _marks(block, escaped)
        within = (total + inside) % 2 == 1
        inside = bool(within[-1])
        raw = block.tobytes()
        cuts = np.flatnonzero(~within & ((block == _COMMA) | (block == _OPEN) | (block == _CLOSE)))
        start = 0
        for cut in cuts.tolist():
            mark, at = block[cut], place + cut
            if held is not None and (mark != _COMMA or at >= high):
                # The object ends, or an entry that is another range's begins.
                yield from _parsed(held + raw[start:cut])
                held = None
            if mark == _OPEN and at < high:
                yield from _outside(handle, 0, at)
                if held is not None:
                    yield None, None, True
                held, start = b"", cut + 1
            elif mark == _COMMA and at < high and held is None:
                held, start = b"", cut + 1
            elif mark == _CLOSE and at < high:
                yield from _outside(handle, at + 1, size)
            if at >= high and held is None:
                return
        if held is not None:
            held += raw[start:]
        place += len(block)
        handle.seek(place)
        if held is None and place >= high:
            break
    if held is not None or (high == size and not _closed(handle, size)):
        yield None, None, True  # the object does not end
    if low == 0 and not _opens(handle):
        yield None, None, True


def _outside(handle, low: int, high: int) -> Iterator[tuple]:
    """A row where there is more than white space before or behind the object."""
    place = handle.tell()
    handle.seek(low)
    while low < high:
        piece = handle.read(min(_BLOCK, high - low))
        if not piece or piece.strip(b" \t\r\n"):
            yield None, None, True
            break
        low += len(piece)
    handle.seek(place)


def _opens(handle) -> bool:
    handle.seek(0)
    while piece := handle.read(64):
        if piece.strip(b" \t\r\n"):
            return piece.lstrip(b" \t\r\n").startswith(b"{")
    return False


def _closed(handle, size: int) -> bool:
    while size > 0:
        step = min(64, size)
        handle.seek(size - step)
        piece = handle.read(step)
        if piece.strip(b" \t\r\n"):
            return piece.rstrip(b" \t\r\n").endswith(b"}")
        size -= step
    return False


def _parsed(text: bytes) -> Iterator[tuple]:
    if not text.strip(b" \t\r\n"):
        return
    try:
        found = json.loads(b"{" + text + b"}")
    except ValueError:
        yield text.decode("utf-8", "replace")[:200], None, False
        return
    for path, mtime in found.items():
        number = isinstance(mtime, (int, float)) and not isinstance(mtime, bool)
        yield path, float(mtime) if number else None, False
