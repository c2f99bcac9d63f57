"""A pass over the tree at a fixed interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsnap.operators.extract import Extractor, default_extractor
from docsnap.options import CrawlOptions
from docsnap.plans.crawl import Listing, Loader, crawl
from docsnap.plans.store import DocumentStore


def recrawl(
    spark: SparkSession,
    options: CrawlOptions,
    store: DocumentStore,
    checkpoint: str,
    extractor: Extractor = default_extractor,
    every_seconds: float = 900.0,
    source: str = "recrawl",
    listing: Listing | None = None,
    load: Loader | None = None,
    ticks: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Crawl again and again; the trigger keeps the interval and the store the runs apart.

    ``listing`` and ``load`` are as for ``crawl``. Each micro-batch of ``ticks``, a clock unless another stream
    is given, is one pass.
    """
    if ticks is None:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(_: DataFrame, batch_id: int) -> None:
        crawl(spark, options, store, extractor, source, batch_id, listing, load)

    return (
        ticks.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{every_seconds} seconds"}))
        .start()
    )
