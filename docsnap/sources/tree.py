"""Listing of a file tree that every executor can reach.

The tree is listed level by level: all directories of one level are spread over the tasks,
so neither a deep nor a lopsided tree leaves a single task with the work. Names come first;
files are looked at (size and times) in a second pass, spread anew, after name patterns have
taken out what is not wanted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.functions.paths import clean_root
from docsnap.schema import NAMES, STATS
from docsnap.session import materialised, tasks_for

_ROWS = 10_000
_FOLDERS_PER_TASK = 500
_FILES_PER_TASK = 50_000


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def identity(path: str) -> str:
    info = os.stat(path)
    return f"{info.st_dev}:{info.st_ino}"


def children(
    path: str, lineage: list[str], follow_symlinks: bool, continue_on_error: bool, is_root: bool
) -> Iterator[tuple]:
    """Entries of one directory; one error row where it may not be read."""
    try:
        entries = os.scandir(path)
    except PermissionError as problem:
        if not continue_on_error:
            raise
        yield path, True, None, None, f"PermissionError: {problem}"
        return
    except FileNotFoundError:
        if is_root:
            raise
        return  # gone since its parent was listed
    with entries:
        for entry in entries:
            link = entry.is_symlink()
            if link and not follow_symlinks:
                continue
            try:
                entry.path.encode()
            except UnicodeEncodeError:
                shown = os.fsencode(entry.path).decode("utf-8", "replace")
                yield shown, None, link, None, "the name is not UTF-8"
                continue
            try:
                is_dir = entry.is_dir(follow_symlinks=follow_symlinks)
                if not is_dir and not entry.is_file(follow_symlinks=follow_symlinks):
                    continue
                above = lineage
                if is_dir and follow_symlinks:
                    here = identity(entry.path)
                    if here in lineage:
                        continue  # a link back to a directory on the way down
                    above = [*lineage, here]
            except OSError:
                continue
            yield entry.path, is_dir, link, above if is_dir else None, None


def list_names(
    spark: SparkSession,
    root: str,
    follow_symlinks: bool = False,
    continue_on_error: bool = False,
    keep: Callable[[DataFrame], DataFrame] = materialised,
) -> DataFrame:
    """Every directory and file below the root: ``path, is_dir, is_symlink, error``.

    The root is the first row. An unreadable directory fails the listing, or adds a row with
    an ``error`` where ``continue_on_error`` is set. ``keep`` stores each level.
    """
    base = clean_root(root)
    if not os.path.isabs(base):
        raise ValueError("the root must be an absolute path")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in batches:
                for path, lineage in zip(frame["path"], frame["lineage"]):
                    yield from children(
                        path, list(lineage), follow_symlinks, continue_on_error, path == base
                    )

        yield from frames(rows(), NAMES.fieldNames())

    top = [identity(base)] if follow_symlinks else []
    level = spark.createDataFrame([(base, True, False, top, None)], NAMES)
    listed, waiting = level, 1
    while waiting:
        directories = level.filter("is_dir and error is null").select("path", "lineage")
        tasks = tasks_for(spark, waiting, _FOLDERS_PER_TASK)
        level = keep(directories.repartition(tasks).mapInPandas(scan, NAMES))
        listed = listed.unionByName(level)
        waiting = level.filter("is_dir and error is null").count()
    return listed.drop("lineage")


def with_stats(
    files: DataFrame, follow_symlinks: bool = False, tasks: int | None = None
) -> DataFrame:
    """Add size and times; a file that is gone by now drops out.

    Without ``tasks`` the rows are counted to choose their number.
    """
    columns = files.columns
    schema = T.StructType(files.schema.fields + STATS.fields)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in batches:
                at = frame.columns.get_loc("path")
                for row in frame.itertuples(index=False, name=None):
                    try:
                        info = os.stat(row[at], follow_symlinks=follow_symlinks)
                    except OSError:
                        continue
                    born = getattr(info, "st_birthtime", None)
                    yield *row, info.st_size, info.st_mtime, info.st_atime, born

        yield from frames(rows(), [*columns, *STATS.fieldNames()])

    if tasks is None:
        tasks = tasks_for(files.sparkSession, files.count(), _FILES_PER_TASK)
    return files.repartition(tasks).mapInPandas(look, schema)


def binary_file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files of an object store through the built-in source: path, length and mtime.

    It hides names that start with ``_`` or ``.``, follows links, lists no directories and
    cuts times to milliseconds. Do not mix it with ``list_names`` over one snapshot.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    return files.select(
        F.regexp_replace("path", r"\Afile:/+", "/").alias("path"),
        "length",
        (F.unix_millis("modificationTime") / 1000.0).alias("mtime"),
    )
