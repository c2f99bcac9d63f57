"""Counts per node of the path tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.functions.paths import tree_tokens


def path_tree_facets(
    paths: DataFrame, column: str = "path", weight: Column | None = None
) -> DataFrame:
    """``node`` and the number of rows at or below it, or the sum of their weights.

    Rows are counted per directory before the directories are expanded to their ancestors, so
    the expansion grows with the number of directories, not of files.
    """
    path = F.translate(F.col(column), "\\", "/")
    weight = F.lit(1) if weight is None else weight
    files = paths.select(path.alias("node"), weight.cast("bigint").alias("files")).filter(F.col("node") != "")
    above = F.left("node", F.length("node") - F.length(F.substring_index("node", "/", -1)) - 1)
    directories = (
        files.filter(F.contains("node", F.lit("/")))
        .groupBy(above.alias("directory"))
        .agg(F.sum("files").alias("files"))
        .select(F.explode(tree_tokens(F.col("directory"))).alias("node"), "files")
    )
    return (
        files.unionByName(directories)
        .groupBy("node")
        .agg(F.sum("files").alias("files"))
    )
