"""The pipeline against its stages done by hand."""

import re
import zlib
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from docsnap.llm import decontaminate, language, mixing, records

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given tables with a few odd rows and an extra column."""
    place = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    odd = spark.createDataFrame(
        [(5000, None, "en", "s", 0), (5001, "", None, None, 0), (5002, f"Before this. {item} After", "en", None, 9), (5003, "?!", "x", "s", 2)],
        docs.schema,
    )
    docs.unionByName(odd).withColumn("doc", F.lit("extra")).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{place}/benchmark.parquet")
    return place


def distance(item, text):
    masks = {}
    for k, byte in enumerate(item):
        masks[byte] = masks.get(byte, 0) | 1 << k
    return decontaminate.least_edits(item, masks, text)


def test_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = language.predicted_languages(docs).collect()
    good = {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in good]
    keep = {d for d, c, _ in brute([r[:2] for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in keep]
    items = [decontaminate.plain_text(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = []
    for row in rows:
        plain = decontaminate.plain_text(row[1])
        if not any(distance(i, plain) <= decontaminate.MAX_DISTANCE * len(i) for i in items):
            clean.append(row)
    assert len(clean) < len(rows)
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    connection.executemany("insert into documents values (?, ?, ?)", clean)
    taken = {r[0]: r[1] // max(1, r[2]) for r in connection.execute(f"select doc_id, taken, size from ({mixing.SQL})").fetchall()}
    model = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    expected = []
    for doc_id, text, _ in sorted(clean):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected += [(doc_id, len(ids), zlib.crc32(ids.tobytes()))] * taken[doc_id]
    starts = [0, *accumulate(n for _, n, _ in expected)]
    found = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1])
    assert found == [(d, s, n, c) for (d, n, c), s in zip(expected, starts[:-1], strict=True)]
    assert len({re.sub(r"\d", "", name) for name, _ in corpus_pipeline.STAGES}) == 5


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
