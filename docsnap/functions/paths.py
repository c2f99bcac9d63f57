"""Path columns: parents, virtual paths, tree tokens, walk order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_root(root: str) -> str:
    """The root without trailing slashes; ``/`` stays as it is."""
    return root.rstrip("/") or "/"


def _below(root: str) -> str:
    return "" if root == "/" else root


def parent(path: Column) -> Column:
    """The directory of an absolute path."""
    name = F.substring_index(path, "/", -1)
    above = F.left(path, F.length(path) - F.length(name) - 1)
    return F.when(above == "", F.lit("/")).otherwise(above)


def virtual_path(real: Column, root: str) -> Column:
    """The path relative to the root with a leading slash, or ``/name`` outside of it."""
    below = _below(clean_root(root))
    inside = F.startswith(real, F.lit(below + "/"))
    return F.when(inside, F.substring(real, len(below) + 1, 2**31 - 1)).otherwise(
        F.concat(F.lit("/"), F.substring_index(real, "/", -1))
    )


def folder_virtual_path(real: Column, root: str) -> Column:
    return F.when(real == clean_root(root), F.lit("/")).otherwise(virtual_path(real, root))


def path_struct(real: Column, root: str) -> Column:
    return F.struct(
        real.alias("real"), F.lit(root).alias("root"), virtual_path(real, root).alias("virtual")
    )


def folder_path_struct(real: Column, root: str) -> Column:
    base = clean_root(root)
    return F.struct(
        real.alias("real"),
        F.lit(base).alias("root"),
        folder_virtual_path(real, base).alias("virtual"),
    )


def walk_order(path: Column) -> Column:
    """A key that sorts like a depth-first walk with names sorted in each directory.

    The parts are compared one by one; the whole string would put ``/`` after ``-`` and ``.``.
    """
    return F.split(path, "/", -1)


def tree_tokens(path: Column) -> Column:
    """Every ancestor of a path and the path itself; backslashes count as slashes."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    return F.filter(prefixes, lambda token: token != "")
