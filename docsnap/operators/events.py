"""File-change events to operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.operators.filters import file_events, outside_pauses
from docsnap.options import CrawlOptions


def accepted_events(
    events: DataFrame, options: CrawlOptions, pauses: DataFrame | None = None
) -> DataFrame:
    """Events that lead to an operation, with ``op`` index or delete."""
    kept = file_events(events, options)
    if pauses is not None:
        kept = outside_pauses(kept, pauses)
    return kept.withColumn("op", F.when(F.col("kind") == "deleted", "delete").otherwise("index"))


def latest_events(events: DataFrame) -> DataFrame:
    """``path, ts, event_id, op`` of the last accepted event per path.

    Applying it alone ends in the same state as applying all. The maximum is taken before the
    shuffle as well, so a path with very many events costs one row per task.
    """
    return (
        events.groupBy(F.col("src_path").alias("path"))
        .agg(F.max(F.struct("ts", "event_id", "op")).alias("last"))
        .select("path", "last.*")
    )
