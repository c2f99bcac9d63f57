"""Listing of a tree on any storage, as a data source of Spark.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("root", "s3://bucket/data").load()

The driver only looks for enough directories near the top to keep the executors busy; each becomes a
partition, and an executor lists what is below it. A mounted tree is listed by its paths, other
storage by its URI through Arrow. No file index is built, names that begin with ``_`` or ``.`` stay, and
directories, also empty ones, have rows of their own.

A partition may be told to stop after ``most`` directories. ``list_storage`` deals out what is left
anew, round by round, so that one large directory tree below another is not one task's work.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsnap.functions.paths import clean_root
from docsnap.options import CrawlOptions
from docsnap.schema import LISTED
from docsnap.session import materialised, tasks_for
from docsnap.sources.tree import children, frames, identity

MOST_FOLDERS = 2_000
_FOLDERS_PER_TASK = 200


def seconds(nanoseconds: int) -> float:
    """A time as ``os.stat`` gives it in seconds."""
    whole, rest = divmod(nanoseconds, 1_000_000_000)
    return whole + 1e-9 * rest


class Tree:
    """What a root names, and how its directories are listed."""

    def __init__(self, root: str, follow_symlinks: bool, continue_on_error: bool) -> None:
        self.follow_symlinks, self.continue_on_error = follow_symlinks, continue_on_error
        self.store, scheme = None, ""
        if "://" in root and not root.startswith("file://"):
            uri = root.partition("?")[0].rstrip("/")
            self.store, root = FileSystem.from_uri(root)
            scheme = uri.removesuffix(clean_root(root))
        self.scheme = scheme
        self.root = scheme + clean_root(root.removeprefix("file://"))
        if self.store is None and not os.path.isabs(self.root):
            raise ValueError("the root must be an absolute path or a URI")

    def lineage(self, path: str) -> list[str]:
        """What tells a link back to a directory on the way down, where links are followed."""
        return [identity(path)] if self.follow_symlinks and self.store is None else []

    def entries(self, path: str, lineage: list[str]) -> Iterator[tuple]:
        """Rows of what is in a directory, and the lineage of each directory."""
        if self.store is None:
            yield from self._mounted(path, lineage)
            return
        place = path.removeprefix(self.scheme)
        try:
            found = self.store.get_file_info(FileSelector(place, allow_not_found=path != self.root))
        except PermissionError as problem:
            if not self.continue_on_error:
                raise
            yield path, True, None, None, f"PermissionError: {problem}", None
            return
        for entry in found:
            name = self.scheme + entry.path.rstrip("/")
            if entry.type == FileType.Directory:
                yield name, True, None, None, None, lineage
            elif entry.type == FileType.File:
                yield name, False, entry.size, entry.mtime_ns and seconds(entry.mtime_ns), None, None

    def _mounted(self, path: str, lineage: list[str]) -> Iterator[tuple]:
        found = children(path, lineage, self.follow_symlinks, self.continue_on_error, path == self.root)
        for name, is_dir, _, below, error in found:
            if is_dir or error is not None:
                yield name, is_dir, None, None, error, below
                continue
            try:
                info = os.stat(name, follow_symlinks=self.follow_symlinks)
            except OSError:
                continue  # gone since its directory was listed
            yield name, False, info.st_size, info.st_mtime, None, None

    def walk(self, start: list[tuple[str, list[str]]], most: int, deep: bool = True) -> Iterator[tuple]:
        """Rows of all below some directories; beyond ``most`` of them, rows of what is left to do."""
        waiting, done = deque(start), 0
        while waiting:
            path, lineage = waiting.popleft()
            if done == most:
                yield path, None, None, None, None, lineage
                continue
            done += 1
            for *row, below in self.entries(path, lineage):
                yield *row, None
                if deep and row[1] and row[4] is None:
                    waiting.append((row[0], below or []))


@dataclass
class Part(InputPartition):
    path: str
    lineage: list[str]
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        # Spark hands on the names of options in small letters.
        options = {name.lower(): value for name, value in options.items()}
        follow, go_on = (options.get(name, "").lower() == "true" for name in ("followsymlinks", "continueonerror"))
        self.settings = options["root"], follow, go_on
        self.splits = int(options.get("splits", "64"))
        self.most = int(options.get("most", str(2**62)))

    def partitions(self) -> list[Part]:
        """Directories near the top, until there are enough; those looked into are listed alone."""
        tree = Tree(*self.settings)
        waiting, parts = deque([(tree.root, tree.lineage(tree.root))]), []
        while waiting and len(waiting) < self.splits and len(parts) < self.splits:
            path, lineage = waiting.popleft()
            parts.append(Part(path, lineage, False))
            for *row, below in tree.entries(path, lineage):
                if row[1] and row[4] is None:
                    waiting.append((row[0], below or []))
        return parts + [Part(path, lineage, True) for path, lineage in waiting]

    def read(self, part: Part) -> Iterator[tuple]:
        tree = Tree(*self.settings)
        if part.path == tree.root:
            yield tree.root, True, None, None, None, None
        yield from tree.walk([(part.path, part.lineage)], self.most, part.deep)


class TreeSource(DataSource):
    """Options: ``root``, ``followSymlinks``, ``continueOnError``, ``splits`` (directories to part the
    listing by) and ``most`` (directories a partition lists before it leaves the rest)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self):
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_storage(
    spark: SparkSession,
    root: str,
    follow_symlinks: bool = False,
    continue_on_error: bool = False,
    keep: Callable[[DataFrame], DataFrame] = materialised,
    most: int = MOST_FOLDERS,
) -> DataFrame:
    """Every directory and file below the root: ``path, is_dir, length, mtime, error``.

    The root is the first row. A directory that may not be read fails the listing, or adds a row with an
    ``error`` where ``continue_on_error`` is set. ``keep`` stores each round.
    """
    spark.dataSource.register(TreeSource)
    settings = (root, follow_symlinks, continue_on_error)
    options = {"root": root, "followSymlinks": str(follow_symlinks), "continueOnError": str(continue_on_error)}
    options |= {"splits": str(2 * spark.sparkContext.defaultParallelism), "most": str(most)}

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(*settings)

        def rows() -> Iterator[tuple]:
            for frame in batches:
                start = [(path, list(todo)) for path, todo in zip(frame["path"], frame["todo"])]
                yield from tree.walk(start, most)

        yield from frames(rows(), LISTED.fieldNames())

    listed = level = keep(spark.read.format("tree").options(**options).load())
    while waiting := level.filter("todo is not null").count():
        tasks = tasks_for(spark, waiting, _FOLDERS_PER_TASK)
        left = level.filter("todo is not null").select("path", "todo")
        level = keep(left.repartition(tasks).mapInPandas(go_on, LISTED))
        listed = listed.unionByName(level)
    return listed.filter("todo is null").drop("todo")


def storage_listing(spark: SparkSession, options: CrawlOptions) -> DataFrame:
    """A listing for ``crawl`` over any storage, with directories and errors."""
    return list_storage(spark, options.root, options.follow_symlinks, options.continue_on_error).withColumn(
        "is_dir", F.coalesce("is_dir", F.lit(False))
    )
