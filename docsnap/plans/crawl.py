"""One pass over a file tree: list, compare, extract, write operations, commit."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsnap.functions.names import file_name, passes_patterns
from docsnap.functions.paths import clean_root
from docsnap.operators.diff import change_feed
from docsnap.operators.documents import with_document
from docsnap.operators.extract import Extractor, default_extractor
from docsnap.operators.filters import eligible_files, size_guard
from docsnap.operators.folders import folders_of
from docsnap.operators.ops import delete_ops, file_ops, folder_delete_ops, folder_ops
from docsnap.options import CrawlOptions
from docsnap.plans.store import DocumentStore
from docsnap.schema import DOCUMENT
from docsnap.session import WorkTables
from docsnap.sources.content import read_and_extract
from docsnap.sources.tree import binary_file_listing, list_names, with_stats


#: From a session and options to ``path, length, mtime`` of all files, or with ``is_dir`` and ``error`` of all
#: that a tree holds.
Listing = Callable[[SparkSession, CrawlOptions], DataFrame]
#: From rows with ``path, length, mtime`` to the same with ``metadata, text, error`` and ``data``.
Loader = Callable[[DataFrame], DataFrame]


class CrawlError(RuntimeError):
    """Files could not be processed and the options do not allow to go on."""


def list_eligible(names: DataFrame, options: CrawlOptions) -> DataFrame:
    """Files that pass the patterns and the size guard, with size and times."""
    wanted = names.filter("not is_dir and error is null").filter(
        passes_patterns(file_name(F.col("path")), options.includes, options.excludes)
    )
    stats = with_stats(wanted.select("path"), options.follow_symlinks)
    return size_guard(stats, options.ignore_above)


def extracted_documents(
    files: DataFrame, extractor: Extractor, options: CrawlOptions, indexed_at: datetime
) -> DataFrame:
    loaded = read_and_extract(files, extractor, options.needs_bytes, options.read_partitions)
    return with_document(loaded, options, F.lit(indexed_at).cast("timestamp"))


def object_listing(spark: SparkSession, options: CrawlOptions) -> DataFrame:
    """The files of any storage that Spark reads, by its built-in source."""
    return binary_file_listing(spark, options.root)


def next_snapshot(feed: DataFrame, failed: DataFrame, retry_failed: bool = True) -> DataFrame:
    """The snapshot after a run.

    With ``retry_failed`` a failed path keeps the mtime it had before, or stays out if it was
    unknown, so that the next run takes it up again.
    """
    alive = feed.filter(F.col("status") != "deleted")
    if not retry_failed:
        return alive.select("path", "mtime")
    marked = alive.join(
        failed.select("path").distinct().withColumn("failed", F.lit(True)), "path", "left"
    )
    mtime = F.when(F.col("failed"), F.col("previous_mtime")).otherwise(F.col("mtime"))
    return marked.select("path", mtime.alias("mtime")).filter(F.col("mtime").isNotNull())


def crawl(
    spark: SparkSession,
    options: CrawlOptions,
    store: DocumentStore,
    extractor: Extractor = default_extractor,
    source: str = "crawl",
    batch_id: int | None = None,
    listing: Listing | None = None,
    load: Loader | None = None,
) -> int:
    """Bring the store in step with the tree; returns the run id.

    ``listing`` and ``load`` replace the walk over a mounted tree and the reading of files, such
    as by ``storage_listing`` for an object store; folders follow from the paths of files where a
    listing has none.
    The comparison is written once to the shared folder and feeds the reader, the deletions
    and the new snapshot. Contents are read only for new and modified files. The snapshot and
    the commit come after the operations: a run that fails before leaves no trace.
    """
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    run_id, done = store.begin(source, batch_id)
    if not done:
        with WorkTables(spark) as work:
            feed = _write_ops(spark, options, store, extractor, run_id, work, listing, load)
            failed = store.written_ops(run_id).filter("op = 'error'").select("path")
            store.write_snapshot(run_id, next_snapshot(feed, failed, options.retry_failed))
        store.commit(run_id, source, "crawl", batch_id, options.job, started)
    return run_id


def _write_ops(
    spark: SparkSession,
    options: CrawlOptions,
    store: DocumentStore,
    extractor: Extractor,
    run_id: int,
    work: WorkTables,
    listing: Listing | None,
    load: Loader | None,
) -> DataFrame:
    """Write the operations of a run; returns the comparison they came from."""
    indexed_at = datetime.now(timezone.utc)
    if listing is None:
        names = list_names(
            spark, options.root, options.follow_symlinks, options.continue_on_error, work.keep
        )
        files = list_eligible(names, options)
    else:
        listed = work.keep(listing(spark, options).withColumn("mtime", F.col("mtime").cast("double")))
        if "is_dir" in listed.columns:
            names = listed.filter("is_dir or error is not null").select("path", "is_dir", "error")
            listed = listed.filter("not is_dir and error is null").select("path", "length", "mtime")
        else:
            names = folders_of(listed, options.root).select(
                "path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("error")
            )
        files = eligible_files(listed, options)
    feed = work.keep(change_feed(files, store.snapshot(options.job)))
    changed = feed.filter(F.col("status").isin("new", "modified"))
    if load is None:
        documents = extracted_documents(changed, extractor, options, indexed_at)
    else:
        documents = with_document(load(changed), options, F.lit(indexed_at).cast("timestamp"))
    unlisted = names.filter("error is not null").select(
        "path",
        "error",
        F.lit(None).cast("string").alias("_id"),
        F.lit(None).cast(DOCUMENT).alias("doc"),
    )
    if not options.continue_on_error:
        documents, unlisted = _no_errors(documents), _no_errors(unlisted)
    ops = file_ops(documents, options).unionByName(file_ops(unlisted, options))
    if options.index_folders:
        folders = names.filter("is_dir and error is null").select("path")
        ops = ops.unionByName(folder_ops(folders, options))
        if options.prune_folders:
            root = clean_root(options.root)
            below = (F.col("_id") == root) | F.startswith("_id", F.lit(root.rstrip("/") + "/"))
            known = store.folders().filter((F.col("_index") == options.folder_index) & below)
            gone = known.select(F.col("_id").alias("path")).join(folders, "path", "left_anti")
            ops = ops.unionByName(folder_delete_ops(gone, options))
    if options.remove_deleted:
        ops = ops.unionByName(delete_ops(feed.filter("status = 'deleted'"), options))
    try:
        store.write_ops(run_id, ops)
    except Exception as problem:
        if "USER_RAISED_EXCEPTION" in str(problem):
            raise CrawlError(str(problem)) from problem
        raise
    return feed


def _no_errors(rows: DataFrame) -> DataFrame:
    """Fail the task at the first row with an error."""
    message = F.concat("path", F.lit(": "), "error")
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(message)))
