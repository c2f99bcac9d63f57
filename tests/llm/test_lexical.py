"""Ranked search against a plain scoring of every document for every item."""

import random
import re
from collections import Counter
from math import floor, log

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from docsnap.llm import lexical
from docsnap.llm.catalog import op11_lexical_search

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, everything = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * c.total() * total // everything
            score = sum(
                floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in words & c.keys()
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda s: s[:3])
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus():
    rng = random.Random(11)
    words = [f"W{i}" for i in range(40)] + ["é", "ÀÉ", "日本", "x\u0085y", "a1"] + [f"rare{i}" for i in range(200)]
    docs = [(i, rng.choice([" ", "-", "\x7f", "\x00"]).join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 rare7") for i in range(200)]  # one mask, equal scores
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (7, ""), (8, "?! \t"), (9, "W1 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)]
    items += [(100, " ".join(words * 2)), (101, "nowhere else"), (102, None), (103, ""), (None, "w1"), (104, "w1"), (104, "w2 w3")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, -1, "x") for r in docs], "doc_id long, text string, score int, term string").repartition(5)
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")


def test_like_brute_force(tables):
    assert rows(lexical.search(*tables)) == brute(*corpus())


def test_small_slices_blocks_and_masks(tables, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_ROWS", 50)
    monkeypatch.setattr(lexical, "MASK_CELLS", 500)
    monkeypatch.setattr(lexical, "ROUND_DOCS", 2)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 100)
    assert rows(lexical.search(*tables, block_bytes=600)) == brute(*corpus())


def test_other_top_and_text_ids(spark):
    docs = [(i, "a b c"[: 1 + i % 5]) for i in range(20)]
    items = [("one", "A c"), ("two", "b")]
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"), top=3
    )
    assert rows(found) == brute(docs, items, 3)


def test_masks_group_and_stop_early(spark, monkeypatch):
    """Documents of masks that cannot reach the best are never scored."""
    import numpy as np
    import pyarrow as pa

    n = 1000
    held = [[0, 1, 2]] * 20 + [[0]] * (n - 20)
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(n), pa.int64()), "n": pa.array([10] * n, pa.int64()),
         "terms": pa.array(held, pa.list_(pa.int32())), "counts": pa.array([[1] * len(h) for h in held], pa.list_(pa.int64()))}
    )
    part = lexical.Slice(batch, n, 10 * n)
    scored = []
    scores = lexical.Slice.scores
    monkeypatch.setattr(lexical.Slice, "scores", lambda self, r, w: scored.extend(r.tolist()) or scores(self, r, w))
    monkeypatch.setattr(lexical, "ROUND_DOCS", 10)
    ranking = lexical.Ranking(np.array([0, 1, 2]), np.array([5, 5, 5]), 10)
    ranking.take(part, np.zeros(3, np.int64))
    assert ranking.ids.tolist() == list(range(10))
    assert sorted(scored) == list(range(20))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexical.search(docs, items)) == []
    assert rows(lexical.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id"))) == []


def test_query_like_sql(spark):
    assert rows_of_spark(op11_lexical_search(spark, FOLDER)) == rows_of_sql(connect(FOLDER), lexical.SQL)
