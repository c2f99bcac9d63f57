"""A corpus pipeline: language, near copies, benchmark leaks, mix of sources, token records.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsnap.llm import decontaminate, language, mixing, ngram_join, records
from docsnap.llm.common import keep, table

#: Texts whose language is told with less than this are rejected, as are texts without a letter.
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known from the labelled ones."""
    return language.identified_documents(docs, LEAST_SCORE)


def join_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id."""
    return ngram_join.one_of_each_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records of the documents, as read back from the record files."""
    return records.token_records(docs)


STAGES = [
    ("language", identify),
    ("near_copies", join_copies),
    ("benchmark", decontaminated),
    ("mix", mix),
    ("records", encode),
]

#: A trained model and a tokenizer are not SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
