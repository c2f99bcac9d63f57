"""Folder documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.functions.paths import clean_root, folder_path_struct, parent, tree_tokens


def folders_of(files: DataFrame, root: str) -> DataFrame:
    """Distinct directories above the files, down from and with the root.

    For listings without directory rows; an empty directory cannot be seen this way. The
    files are reduced to their distinct parents before any path is expanded.
    """
    base = clean_root(root)
    inside = "/" if base == "/" else base + "/"
    return (
        files.select(parent(F.col("path")).alias("path"))
        .distinct()
        .select(F.explode(tree_tokens(F.col("path"))).alias("path"))
        .filter((F.col("path") == base) | F.startswith("path", F.lit(inside)))
        .distinct()
    )


def folder_documents(folders: DataFrame, root: str) -> DataFrame:
    """``_id`` and ``path_info`` for rows with the ``path`` of a directory."""
    return folders.select(
        F.col("path").alias("_id"), folder_path_struct(F.col("path"), root).alias("path_info")
    )
