"""Mixing against its SQL and on hand-made rows."""

import re

import duckdb
import pytest
from oracle import rows_of_spark, rows_of_sql

from docsnap.llm import mixing

ROWS = [(i, f"s{i % 4}" if i % 5 else None, " ".join(["w"] * (i % 7))) for i in range(200)]
ROWS += [(i % 3, "hot", "a b\tc\x0bd e") for i in range(100)] + [(999, "none", None), (None, "hot", "a")]


def test_like_sql(spark):
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame(ROWS, schema)
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    connection.executemany("insert into documents values (?, ?, ?)", ROWS)
    assert rows_of_spark(mixing.mixed_words(df)) == rows_of_sql(connection, mixing.SQL)


def test_targets_and_repeats(spark):
    rows = [(i, "a", "x y") for i in range(300)] + [(1000 + i, "b", "x") for i in range(50)]
    rows += [(2000 + i, "c", "x y z") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed_words(df).collect()
    by = {s: [r for r in out if (r["doc_id"] < 1000, r["doc_id"] < 2000).count(True) == k] for s, k in (("a", 2), ("b", 1), ("c", 0))}
    total = sum(len(re.findall(mixing.WORD, t)) for _, _, t in rows)
    assert sum({(r["source_size"], r["target"]) for r in out}.pop()[1] for _ in [0]) > 0
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    assert by["a"][0]["target"] == 3 * 600 and by["b"][0]["target"] == 3 * 50
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 3
        assert all(r["taken"] <= 3 * r["size"] for r in v)


def test_documents_follow_the_plan(spark):
    df = spark.createDataFrame([(d, s, t, 1) for d, s, t in ROWS], "doc_id long, source string, text string, h int")
    words = {}
    for r in mixing.mixed_words(df).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["taken"]
    taken = {}
    for r in mixing.mixed_documents(df).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(re.findall(mixing.WORD, r["text"] or ""))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [r["taken"] for r in mixing.mixed_words(df).collect()] == [0] * len(rows)
