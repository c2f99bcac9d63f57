"""Uploads and delete requests applied to the store.

Both take a table of requests, of a batch or of one micro-batch of a stream.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.operators.extract import Extractor
from docsnap.operators.ops import requested_deletes, upload_ops
from docsnap.operators.uploads import build_uploads, upload_results
from docsnap.options import CrawlOptions
from docsnap.plans.store import DocumentStore
from docsnap.session import WorkTables


def apply_uploads(
    uploads: DataFrame,
    store: DocumentStore,
    options: CrawlOptions,
    extractor: Extractor,
    source: str = "uploads",
    batch_id: int | None = None,
) -> int:
    """Index the uploads and write one response each; returns the run id.

    A simulated upload is built and answered but not indexed, a failed one is answered with
    its error. Uploads of one batch apply in the order of ``upload_id``.
    """
    run_id, done = store.begin(source, batch_id)
    if done:
        return run_id
    indexed_at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    with WorkTables(uploads.sparkSession) as work:
        built = work.keep(build_uploads(uploads, extractor, options, indexed_at))
        store.write_ops(run_id, upload_ops(built, options))
        store.write_responses(run_id, upload_results(built))
    store.commit(run_id, source, "uploads", batch_id)
    return run_id


def apply_deletes(
    requests: DataFrame,
    store: DocumentStore,
    options: CrawlOptions,
    source: str = "deletes",
    batch_id: int | None = None,
) -> int:
    """Delete documents by file name or id; returns the run id."""
    run_id, done = store.begin(source, batch_id)
    if not done:
        store.write_ops(run_id, requested_deletes(requests, options))
        store.commit(run_id, source, "deletes", batch_id)
    return run_id
