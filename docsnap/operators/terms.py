"""Term tables over document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.functions.tokens import terms


def term_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term``, the document key and the term frequency ``tf``; counted before the shuffle."""
    return (
        docs.select(key, F.explode(terms(F.col(text))).alias("term"))
        .groupBy("term", key)
        .agg(F.count("*").alias("tf"))
    )


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """``term`` and the number of documents that hold it, for one row per document."""
    return (
        docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
