"""Quality scores: context sums by hand, odd rows, held-out accuracy."""

import random
import re

import numpy as np
import pytest

from docsnap.llm import catalog, quality


def by_hand(texts):
    """Words as strings, and context sums keyed by word."""
    total = {}
    for text in texts:
        words = [m[0] for m in re.finditer(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]+", text)]
        for i, word in enumerate(words):
            key = "0" if word.isdigit() else word.lower()
            total.setdefault(key, []).append([w for j, w in enumerate(words) if 0 < abs(i - j) <= quality.REACH])
    return total


def raw(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))


def bucket_of(word):
    return int(quality.words(*raw([word]))[0][0])


def test_contexts_by_hand():
    texts = ["The cat, the 12 DOGS!! and iPod", "", " ", "cat cat 345 the", "end"]
    bucket, shape, bounds = quality.words(*raw(texts))
    assert np.diff(bounds).tolist() == [9, 0, 0, 4, 1]
    assert shape[:9].tolist() == [4, 2, 1, 2, 0, 3, 1, 2, 5] and shape[-1] == 2
    table = quality.contexts(bucket, shape, bounds)
    expected = np.zeros_like(table)
    for word, uses in by_hand(texts).items():
        for near in uses:
            expected[bucket_of(word), quality.DIMENSIONS] += 1
            for other in near:
                b = bucket_of(other)
                np.add.at(expected[bucket_of(word)], quality.PLACES[b], quality.VALUES[b].astype(int))
    for b, s in zip(bucket, shape, strict=True):
        np.add.at(expected[b], quality.PLACES[quality.BUCKETS + s], quality.VALUES[quality.BUCKETS + s].astype(int))
    assert (table == expected).all()


def test_table_is_the_sum_over_tasks(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "Cd", "12", "!!", "é"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(7)
    assert (quality.context_table(df) == quality.contexts(*quality.words(*raw(texts)))).all()


def corpus():
    rng = random.Random(3)
    good = [f"{a}{b}" for a in "abcdef" for b in ("ba", "co", "du")]
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(good) for _ in range(rng.randrange(5, 60)))
        if i % 3 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(i % 3 != 0), 0))
    return rows, labels


def test_odd_rows(spark):
    rows, labels = corpus()
    rows += [(900, None), (901, ""), (902, " \n"), (None, "aba aco"), (903, "aba " * 50_000), (5, rows[5][1])]
    labels += [(5, 1, 0), (7, None, 0), (None, 1, 0), (5000, 0, 0)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, marks).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (900, 901, 902)}) == 1
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in found if r["held_out"] and (r["doc_id"] or 999) < 300]
    assert len(right) > 40 and np.mean(right) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, 1, 0)]])
def test_nothing_to_tell_apart(spark, labels):
    docs = spark.createDataFrame([(i, "a b") for i in range(4)], "doc_id long, text string")
    found = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in found} == {1.0 if labels else 0.5}
    empty = docs.limit(0)
    assert quality.quality_scores(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in catalog.op6_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in found]) > 0.9
