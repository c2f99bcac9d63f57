"""Comparison with a snapshot by digests: parts, then directories, then files.

The snapshot lies in parts by directory, and with it one digest per directory and one per part. A
digest of a directory covers the names and times of its files; digests merge by addition and
exclusive or, so those of a part follow from its directories in any order. A comparison reads the digests
of parts first, then those of directories in parts that differ, then the files of directories that differ. Files of
all other directories are unchanged, and of the snapshot they are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsnap.functions.paths import parent
from docsnap.operators.diff import change_feed
from docsnap.session import WorkTables

PARTS = 256
_SUMS = ("files", "one", "two")


def directory_digests(files: DataFrame, parts: int = PARTS) -> DataFrame:
    """``part, directory`` and the digest of each directory that holds files."""
    row = F.struct(F.col("path"), F.col("mtime").cast("double"))
    return (
        placed(files, parts)
        .groupBy("part", "directory")
        .agg(*_merged(F.lit(1), F.xxhash64(F.lit(1), row), F.xxhash64(F.lit(2), row)))
    )


def _merged(files: Column, one: Column, two: Column) -> list[Column]:
    # Sums of halves cannot overflow; 64 bits of exclusive or and 64 of sums tell digests apart.
    return [
        F.sum(files).alias("files"),
        F.bit_xor(one).alias("one"),
        F.sum(F.shiftright(two, 32)).alias("two"),
    ]


def part_digests(directories: DataFrame) -> DataFrame:
    """The digests of directories merged by part."""
    return directories.groupBy("part").agg(
        F.sum("files").alias("files"), F.bit_xor("one").alias("one"), F.sum("two").alias("two")
    )


def placed(files: DataFrame, parts: int) -> DataFrame:
    """With the directory of each file and the part it belongs to."""
    directory = parent(F.col("path"))
    return files.withColumn("directory", directory).withColumn("part", F.pmod(F.xxhash64("directory"), F.lit(parts)).cast("int"))


def _differing(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys of digests that are not the same on both sides."""
    old = before.select(key, F.struct(*_SUMS).alias("_old"))
    new = now.select(key, F.struct(*_SUMS).alias("_new"))
    return new.join(old, key, "full_outer").filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(key)


class DigestSnapshot:
    """A snapshot of ``path, mtime`` with its digests, in a folder of its own."""

    def __init__(self, spark: SparkSession, location: str, parts: int = PARTS) -> None:
        self.spark, self.location, self.parts = spark, location.rstrip("/"), parts

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.location}/{table}")

    def files(self) -> DataFrame:
        return self._read("files", "path string, mtime double, directory string, part int")

    def directories(self) -> DataFrame:
        return self._read("directories", "directory string, files long, one long, two long, part int")

    def totals(self) -> DataFrame:
        return self._read("parts", "part int, files long, one long, two long")

    def write(self, files: DataFrame) -> None:
        rows = placed(files.select("path", F.col("mtime").cast("double")), self.parts)
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.location}/files")
        digests = directory_digests(files, self.parts)
        digests.repartition("part").write.partitionBy("part").parquet(f"{self.location}/directories")
        part_digests(self.directories()).coalesce(1).write.parquet(f"{self.location}/parts")

    def change_feed(self, files: DataFrame, work: WorkTables) -> DataFrame:
        """As ``change_feed`` against all files of the snapshot; ``files`` is read twice."""
        digests = work.keep(directory_digests(files, self.parts))
        # A number per part: never more than there are parts.
        parts = [row["part"] for row in _differing(part_digests(digests), self.totals(), "part").collect()]
        inside = F.col("part").isin(parts)
        directories = work.keep(
            _differing(digests.filter(inside), self.directories().filter(inside), "directory")
        )
        now = placed(files, self.parts)
        some = now.filter(inside).join(directories, "directory", "left_semi")
        before = self.files().filter(inside).join(directories, "directory", "left_semi")
        changed = change_feed(some.drop("directory", "part"), before.select("path", "mtime"))
        same = now.filter(~inside).unionByName(now.filter(inside).join(directories, "directory", "left_anti"))
        time = F.col("mtime")
        rest = same.drop("directory", "part").withColumns({"status": F.lit("unchanged"), "previous_mtime": time})
        return changed.unionByName(rest.select(*changed.columns))
