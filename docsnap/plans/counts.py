"""Counts that are kept up by what changed.

    base/run_id=N    counts as of run N
    deltas/run_id=N  what run N adds to them, or takes away

A run writes the signed counts of its new and deleted rows only; a reader adds them up. ``fold`` makes
one base of them, from which on older pieces are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsnap.operators.facets import path_tree_facets
from docsnap.session import filesystem

def signed_changes(feed: DataFrame) -> DataFrame:
    """``path`` and ``sign`` of the rows of a change feed that come or go; others are not looked at."""
    sign = F.when(F.col("status") == "new", 1).otherwise(-1)
    return feed.filter(F.col("status").isin("new", "deleted")).select("path", sign.alias("sign"))


def path_deltas(feed: DataFrame) -> DataFrame:
    """``key`` (a node of the path tree) and ``count``, signed."""
    nodes = path_tree_facets(signed_changes(feed), "path", F.col("sign"))
    return nodes.select(F.col("node").alias("key"), F.col("files").alias("count"))


def index_deltas(feed: DataFrame, index: str) -> DataFrame:
    """``key`` (an index) and the documents it gains or loses."""
    total = signed_changes(feed).agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("count"))
    return total.select(F.lit(index).alias("key"), "count")


class KeptCounts:
    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")

    def _runs(self, table: str) -> list[int]:
        files, target = filesystem(self.spark, f"{self.location}/{table}")
        if not files.exists(target):
            return []
        written = [entry.getPath() for entry in files.listStatus(target)]
        done = [p for p in written if files.exists(filesystem(self.spark, f"{p.toString()}/_SUCCESS")[1])]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def add(self, run_id: int, deltas: DataFrame) -> None:
        """Write the deltas of a run; written again, they replace themselves."""
        changed = deltas.groupBy("key").agg(F.sum("count").alias("count")).filter("count <> 0")
        changed.write.mode("overwrite").parquet(f"{self.location}/deltas/run_id={run_id}")

    def counts(self) -> DataFrame:
        """``key`` and ``count`` of all that is left."""
        base = max(self._runs("base"), default=None)
        places = [f"{self.location}/deltas/run_id={n}" for n in self._runs("deltas") if base is None or n > base]
        if base is not None:
            places.append(f"{self.location}/base/run_id={base}")
        schema = "key string, count long"
        rows = self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.sum("count").alias("count")).filter("count <> 0")

    def fold(self) -> None:
        """One base of all pieces so far."""
        newest = max(self._runs("deltas"), default=None)
        if newest is not None:
            self.counts().write.mode("overwrite").parquet(f"{self.location}/base/run_id={newest}")
