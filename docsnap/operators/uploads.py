"""Uploaded files as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.operators.documents import with_upload_document
from docsnap.operators.extract import Extractor
from docsnap.options import CrawlOptions


def build_uploads(
    uploads: DataFrame, extractor: Extractor, options: CrawlOptions, indexed_at: Column
) -> DataFrame:
    """Uploads with extraction, ``doc``, ``_id``, ``_index`` and ``url``."""
    return with_upload_document(extractor(uploads), options, indexed_at)


def upload_results(built: DataFrame) -> DataFrame:
    """The answer per upload; the document only where ``debug`` asks for it."""
    ok = F.col("error").isNull()
    return built.select(
        "upload_id",
        "filename",
        ok.alias("ok"),
        "error",
        F.when(ok, F.col("url")).alias("url"),
        F.when(ok & F.coalesce("debug", F.lit(False)), F.col("doc")).alias("doc"),
    )
