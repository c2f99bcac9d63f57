"""Which files and events take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.functions.names import file_name, passes_patterns
from docsnap.operators.intervals import with_open_intervals
from docsnap.options import CrawlOptions


def size_guard(files: DataFrame, ignore_above: int | None) -> DataFrame:
    """Keep files up to and including the limit; a file without a known size is dropped."""
    return files if ignore_above is None else files.filter(F.col("length") <= ignore_above)


def eligible_files(files: DataFrame, options: CrawlOptions) -> DataFrame:
    """Name patterns, then size. Works on any frame with ``path`` and ``length``."""
    named = files.filter(
        passes_patterns(file_name(F.col("path")), options.includes, options.excludes)
    )
    return size_guard(named, options.ignore_above)


def file_events(events: DataFrame, options: CrawlOptions) -> DataFrame:
    """Events on files; the patterns apply to all kinds but deletions."""
    name = file_name(F.col("src_path"))
    return events.filter(
        ~F.col("is_directory")
        & (
            (F.col("kind") == "deleted")
            | passes_patterns(name, options.includes, options.excludes)
        )
    )


def outside_pauses(events: DataFrame, pauses: DataFrame) -> DataFrame:
    """Drop events with ``start_ts <= ts < end_ts`` of any pause; one without an end goes on.

    However long a pause is, it is two borders in time, and an event looks up how many pauses are
    open where it stands (see ``with_open_intervals``). Events without a time stay, as do pauses without
    a start without effect.
    """
    found = with_open_intervals(events, "ts", pauses, "start_ts", "end_ts")
    return found.filter("open_intervals = 0").drop("open_intervals")
