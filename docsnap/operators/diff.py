"""Comparison of a listing with the previous snapshot.

Both sides have one row per path and should carry narrow columns only: file contents are
read after the comparison, for the changed files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_or_modified(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of ``current`` that are unknown or whose mtime differs, in either direction."""
    before = previous.select("path", F.col("mtime").alias("previous_mtime"))
    return current.join(before, "path", "left").filter(
        F.col("previous_mtime").isNull() | (F.col("mtime") != F.col("previous_mtime"))
    )


def deleted(current: DataFrame, previous: DataFrame, remove_deleted: bool = True) -> DataFrame:
    """Paths of ``previous`` that are no longer eligible in ``current``."""
    if not remove_deleted:
        return previous.select("path").limit(0)
    return previous.select("path").join(current.select("path"), "path", "left_anti")


def change_feed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """All paths of both sides with ``status`` new, modified, unchanged or deleted.

    One shuffle of each side; the other columns of ``current`` are kept.
    """
    now = current.withColumn("_now", F.lit(True)).alias("now")
    before = previous.select(
        F.col("path").alias("previous_path"), F.col("mtime").alias("previous_mtime")
    )
    joined = now.join(before, F.col("path") == F.col("previous_path"), "full_outer")
    status = (
        F.when(F.col("_now").isNull(), "deleted")
        .when(F.col("previous_path").isNull(), "new")
        .when(F.col("mtime") != F.col("previous_mtime"), "modified")
        .otherwise("unchanged")
    )
    others = [c for c in current.columns if c != "path"]
    return joined.select(
        F.coalesce("path", "previous_path").alias("path"), status.alias("status"),
        *others, "previous_mtime",
    )
