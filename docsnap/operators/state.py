"""Current documents from a log of operations: the last operation per id counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["_index", "_id"]
ORDER = ["run_id", "phase", "ord"]


def last_operations(ops: DataFrame) -> DataFrame:
    """The key, order and kind of the last operation per document.

    Only narrow columns take part, and the maximum is taken before the shuffle as well, so an
    id with very many operations costs one row per task.
    """
    last = (
        ops.filter(F.col("op") != "error")
        .groupBy(*KEY)
        .agg(F.max(F.struct(*ORDER, "op")).alias("last"))
    )
    return last.select(*KEY, "last.*")


def newer_operations(last: DataFrame, known: DataFrame | None) -> DataFrame:
    """Last operations without those that come before what is ``known`` of their document.

    For operations that turn up late; ``known`` has the key and order, and nothing else moves.
    """
    if known is None:
        return last
    order = known.select(*KEY, F.struct(*ORDER).alias("_known"))
    marked = last.join(order.groupBy(*KEY).agg(F.max("_known").alias("_known")), KEY, "left")
    return marked.filter(F.col("_known").isNull() | (F.struct(*ORDER) > F.col("_known"))).drop("_known")


def current_state(
    ops: DataFrame, base: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Rows of ``ops`` that make up the current state, on top of an earlier state.

    The documents join their winners on key *and* order: that key is unique on both sides, so
    a document rewritten a million times does not meet itself in one task. ``base`` only loses
    the ids that the operations touch.
    """
    last = newer_operations(last_operations(ops), known)
    winners = last.filter(F.col("op") == "index").drop("op")
    rows = ops.filter(F.col("op") == "index").join(winners, KEY + ORDER)
    if base is None:
        return rows
    kept = base.join(last.select(*KEY), KEY, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def settled_rows(
    ops: DataFrame, last: DataFrame, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The documents of the last operations with as few shuffled as possible, for writing them out.

    ``last`` is stored, and ``keep`` stores which ``index`` operations were superseded, so their
    true sizes are known when the documents meet them. Usually few are superseded; then the planner
    broadcasts those and the documents stay where they are, else it falls back to a shuffle on a
    unique key.
    """
    indexed = ops.filter(F.col("op") == "index")
    winners = last.filter(F.col("op") == "index").drop("op")
    superseded = keep(_without(indexed.select(*KEY, *ORDER), winners, KEY + ORDER))
    return _without(indexed, superseded, KEY + ORDER)


def untouched(base: DataFrame, last: DataFrame) -> DataFrame:
    """Stored rows that no later operation concerns."""
    return _without(base, last.select(*KEY), KEY)


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows that have no partner; as an outer join, which stays above unions of runs."""
    marked = rows.join(others.withColumn("_partner", F.lit(True)), key, "left")
    return marked.filter(F.col("_partner").isNull()).drop("_partner")


def documents_per_index(ops: DataFrame) -> DataFrame:
    """Size of each index; the last operations tell it without touching a document."""
    return (
        last_operations(ops)
        .filter(F.col("op") == "index")
        .groupBy("_index")
        .agg(F.count("*").alias("documents"))
    )


def alias_view(state: DataFrame) -> DataFrame:
    """Documents and folders under one name; ``_index`` tells them apart.

    Folders lack all but the path, so both come from one reading of the state.
    """
    return state.select("_index", "_id", "doc.*")
