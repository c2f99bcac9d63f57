"""File-change events applied to the store as they arrive."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsnap.operators.documents import with_document
from docsnap.operators.events import accepted_events, latest_events
from docsnap.operators.extract import Extractor, default_extractor
from docsnap.operators.ops import delete_ops, file_ops
from docsnap.options import CrawlOptions
from docsnap.plans.crawl import Listing, Loader, crawl
from docsnap.plans.store import DocumentStore
from docsnap.schema import EVENTS
from docsnap.session import materialised
from docsnap.sources.content import read_and_extract
from docsnap.sources.tree import with_stats

logger = logging.getLogger(__name__)

def read_events(spark: SparkSession, location: str, **options: str) -> DataFrame:
    """A stream over a folder of Parquet files with event rows."""
    return spark.readStream.schema(EVENTS).options(**options).parquet(location)


def file_loader(extractor: Extractor, options: CrawlOptions) -> Loader:
    """Rows with a ``path`` to rows with size, times, text and metadata; gone files drop out.

    Of a link it is the target that is looked at, as it is the target that is read. The files are
    looked at once: how many tasks read them and the reading both follow from what was written.
    """

    def load(paths: DataFrame) -> DataFrame:
        stats = materialised(with_stats(paths, follow_symlinks=True))
        return read_and_extract(stats, extractor, options.needs_bytes, options.read_partitions)

    return load


def apply_batch(
    events: DataFrame,
    store: DocumentStore,
    options: CrawlOptions,
    load: Loader,
    source: str,
    batch_id: int,
    pauses: DataFrame | None = None,
) -> None:
    """Write and commit the operations of one micro-batch; a repeated batch changes nothing.

    Only the last event per path acts. A file that cannot be processed adds an error row and
    leaves the stored document as it was.
    """
    run_id, done = store.begin(source, batch_id)
    if done:
        return
    last = latest_events(accepted_events(events, options, pauses)).persist()
    try:
        loaded = load(last.filter("op = 'index'").select("path"))
        indexed_at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        ops = file_ops(with_document(loaded, options, indexed_at), options)
        ops = ops.unionByName(delete_ops(last.filter("op = 'delete'"), options))
        store.write_ops(run_id, ops)
    finally:
        last.unpersist()
    store.commit(run_id, source, "events", batch_id)


def follow_events(
    events: DataFrame,
    store: DocumentStore,
    options: CrawlOptions,
    checkpoint: str,
    extractor: Extractor = default_extractor,
    load: Loader | None = None,
    pauses: DataFrame | None = None,
    source: str = "events",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that applies a stream of events to the store."""
    loader = load or file_loader(extractor, options)

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, store, options, loader, source, batch_id, pauses)

    return (
        events.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def crawl_then_follow(
    spark: SparkSession,
    events: DataFrame,
    store: DocumentStore,
    options: CrawlOptions,
    checkpoint: str,
    extractor: Extractor = default_extractor,
    listing: Listing | None = None,
    load_files: Loader | None = None,
    **follow,
) -> StreamingQuery:
    """A full pass, then the stream from the moment on in which the last committed pass began.

    ``listing`` and ``load_files`` are those of the pass, as ``crawl`` takes them; ``load`` among the other
    options is that of the events. A failed pass does not keep the stream from starting; events since the pass before it then
    count, and all events where there was none. Events that a pass has seen already come again
    and write the same documents.
    """
    try:
        crawl(spark, options, store, extractor, listing=listing, load=load_files)
    except Exception:
        logger.exception("the first pass failed")
    start = store.last_start(options.job)
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return follow_events(events, store, options, checkpoint, extractor, **follow)
