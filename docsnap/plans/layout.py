"""Where the documents of a compacted state lie.

A state is made of pieces, oldest first, all in the same buckets by document. Each piece holds the
documents that changed since the one before, and lists the keys of those in older pieces that they
replace or that were deleted. So a compaction writes what changed. A bucket with too many dead documents is
written anew as a whole into the newest piece; older pieces no longer count for it. The counts
per bucket that decide this are part of the commit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docsnap.operators.state import KEY

_FILE = re.compile(r"_(\d+)(?:\.[^/]*)?$")


def bucket_of(buckets: int) -> Column:
    """The bucket a document lies in, as Spark assigns it."""
    return F.pmod(F.hash(*KEY), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Layout:
    """``since`` has the oldest piece that counts for each bucket, ``rows`` the documents stored in the pieces
    that count, ``dead`` those of them that a later piece replaced or deleted."""

    run_id: int
    buckets: int
    pieces: tuple[int, ...]
    since: tuple[int, ...]
    rows: tuple[int, ...] | None
    dead: tuple[int, ...] | None

    @staticmethod
    def of(commit: Row) -> Layout:
        run_id, buckets = commit["run_id"], commit["buckets"]
        if commit["pieces"] is None:
            return Layout(run_id, buckets, (run_id,), (run_id,) * buckets, None, None)
        return Layout(run_id, buckets, *(tuple(commit[name]) for name in ("pieces", "since", "rows", "dead")))

    @staticmethod
    def whole(run_id: int, rows: Sequence[int], buckets: int) -> Layout:
        return Layout(run_id, buckets, (run_id,), (run_id,) * buckets, tuple(rows), (0,) * buckets)

    def fields(self) -> tuple:
        return self.buckets, list(self.pieces), list(self.since), list(self.rows), list(self.dead)

    @staticmethod
    def counts(rows: Iterable[Row], buckets: int) -> list[int]:
        found = {row["bucket"]: row["count"] for row in rows}
        return [found.get(bucket, 0) for bucket in range(buckets)]

    def per_bucket(self, rows: Iterable[Row]) -> list[int]:
        return self.counts(rows, self.buckets)

    @staticmethod
    def bucket_of_file(name: str) -> int | None:
        """The bucket a file of a piece holds, which Spark writes into its name."""
        found = _FILE.search(name.rpartition("/")[2])
        return int(found[1]) if found else None

    def used(self, piece: int, buckets: Iterable[int]) -> list[int]:
        """Those of the buckets for which the piece counts."""
        return [bucket for bucket in buckets if self.since[bucket] <= piece]

    def counted(self, rows: DataFrame, piece: int) -> DataFrame:
        """The documents of a piece in those buckets for which it counts."""
        past = [bucket for bucket, since in enumerate(self.since) if since > piece]
        return rows.filter(~bucket_of(self.buckets).isin(past)) if past else rows

    def to_rewrite(self, new: Sequence[int], dead: Sequence[int], share: float) -> list[int]:
        """Buckets of which more than that share would be dead."""
        return [
            bucket
            for bucket in range(self.buckets)
            if self.dead[bucket] + dead[bucket] > share * (self.rows[bucket] + new[bucket])
        ]

    def _moved(self, run_id: int, since: list[int], pieces: Iterable[int]) -> Layout:
        used = tuple(p for p in pieces if min(since) <= p)
        return replace(self, run_id=run_id, pieces=(*used, run_id), since=tuple(since))

    def extended(self, run_id: int, new: Sequence[int], dead: Sequence[int], anew: list[int]) -> Layout:
        """With one more piece, which holds some buckets as a whole."""
        since, rows, gone = list(self.since), list(self.rows), list(self.dead)
        for bucket in range(self.buckets):
            rows[bucket] += new[bucket]
            gone[bucket] += dead[bucket]
        for bucket in anew:
            since[bucket], rows[bucket], gone[bucket] = run_id, rows[bucket] - gone[bucket], 0
        return self._moved(run_id, since, self.pieces).sized(rows, gone)

    def merged(self, run_id: int, anew: list[int]) -> Layout:
        """With one piece instead of all but the oldest; its counts are yet to be taken."""
        since = [run_id if b in set(anew) or s > self.pieces[0] else s for b, s in enumerate(self.since)]
        return self._moved(run_id, since, self.pieces[:1])

    def sized(self, rows: Sequence[int], dead: Sequence[int]) -> Layout:
        return replace(self, rows=tuple(rows), dead=tuple(dead))
