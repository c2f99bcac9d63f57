"""Files written from the shared tables, for queries that list and read a real tree.

Every document becomes a file below a new folder of the shared place; some names begin with ``_`` or
``.``, and each language has an empty directory. Executors write and read them through Arrow, so the
shared place may be a mounted folder or any storage Arrow opens.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from docsnap.plans import derived
from docsnap.session import shared_folder, shuffle_width

#: Where a file lies below the root; the same text is part of the SQL of these queries.
PLACE = """concat(source, '/', lang, '/', case doc_id % 6 when 0 then '_' when 3 then '.' else '' end, 'doc_',
  cast(doc_id as {string}), case doc_id % 5 when 3 then '.tmp' when 4 then '.html' else '.txt' end)"""


def plain(uri: str) -> str:
    """A mounted place by its path, another by its URI."""
    return re.sub(r"\Afile:/+", "/", uri)


def opened(uri: str) -> tuple[FileSystem, str]:
    uri = plain(uri)
    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def written_tree(spark: SparkSession, folder: str, links: bool = False) -> str:
    """The root of a tree with one file per document; with ``links``, one to a file and one to a directory in each folder."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened(root)
        known: set[str] = set()
        for batch in batches:
            for place, text in zip(batch["place"], batch["text"], strict=True):
                path = f"{base}/{place}"
                above = path.rpartition("/")[0]
                if above not in known:
                    store.create_dir(f"{above}/none", recursive=True)
                    known.add(above)
                with store.open_output_stream(path) as handle:
                    handle.write((text or "").encode())
                if links:
                    for target, name in ((path, "a_link.txt"), (os.path.dirname(above), "up")):
                        if not os.path.lexists(f"{above}/{name}"):
                            try:
                                os.symlink(target, f"{above}/{name}")
                            except FileExistsError:
                                pass  # another task was faster
            yield pd.DataFrame({"files": [len(batch)]})

    rows = derived.table(spark, folder, "documents").selectExpr(f"{PLACE.format(string='string')} as place", "text")
    dealt = rows.repartition(shuffle_width(spark), "place")
    dealt.mapInPandas(write, "files long").agg({"files": "sum"}).collect()
    return plain(root)


def removed(spark: SparkSession, paths: DataFrame) -> None:
    """Deletes the files of ``path``."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, place = opened(path)
                store.delete_file(place)
            yield pd.DataFrame({"files": [len(batch)]})

    paths.select("path").mapInPandas(remove, "files long").agg({"files": "sum"}).collect()


def written_json(spark: SparkSession, snapshot: DataFrame) -> str:
    """The place of a file with ``path, mtime`` as one JSON object on one line, as another program may leave it."""
    place = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}.json"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, target = opened(place)
        entries = 0
        with store.open_output_stream(target) as handle:
            handle.write(b"{")
            for batch in batches:
                for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
                    handle.write(f"{', ' if entries else ''}{json.dumps(path)}: {mtime!r}".encode())
                    entries += 1
            handle.write(b"}")
        yield pd.DataFrame({"entries": [entries]})

    # One stream of bytes has one writer.
    snapshot.coalesce(1).mapInPandas(write, "entries long").collect()
    return place
