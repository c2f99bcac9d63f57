"""Windows that earlier documents hold, against a plain search of all windows."""

import hashlib
import random

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from docsnap.llm import subtrees
from docsnap.llm.catalog import op12_substring_dedup

FOLDER = "/root/testdata/sf0.001"
N = subtrees.LENGTH


def brute(docs):
    words = [(t or "").encode().split() for _, t in docs]
    rank = [d if d is not None else float("inf") for d, _ in docs]
    least = {}
    for r, w in zip(rank, words, strict=True):
        for i in range(len(w) - N + 1):
            key = tuple(w[i : i + N])
            least[key] = min(least.get(key, r), r)
    out = []
    for (d, _), r, w in zip(docs, rank, words, strict=True):
        gone = set()
        for i in range(len(w) - N + 1):
            if least[tuple(w[i : i + N])] < r:
                gone.update(range(i, i + N))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus():
    rng = random.Random(12)
    few, many = [f"f{i}" for i in range(3)], [f"m{i}" for i in range(500)]
    some = lambda pool, k: [rng.choice(pool) for _ in range(k)]
    passage, template = some(many, 40), some(many, 80)
    docs = []
    for i in range(60):  # a passage at any place, whole or cut
        cut = rng.randrange(10)
        docs.append((i, " ".join(some(many, rng.randrange(30)) + passage[cut : cut + rng.randrange(10, 40)] + some(many, 20))))
    for i in range(100, 180):  # near copies
        text = list(template)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(many)
        docs.append((i, " \t".join(text)))
    docs += [(200 + i, " ".join(template)) for i in range(40)]  # exact copies
    docs += [(300 + i, " ".join(some(few, 60))) for i in range(20)]  # few words, much by chance
    docs += [(400, " ".join(passage * 3)), (401, " ".join(["a"] * 100)), (402, " ".join(["a"] * 50))]
    long = "z" * 300
    docs += [(403, " ".join([long, *many[:20]])), (404, " ".join(["y", long, *many[:20]])), (405, " ".join(["z" * 299, *many[:20]]))]
    docs += [(406, " ".join(passage[:N])), (407, " ".join(passage[: N - 1])), (408, None), (409, ""), (410, " \n\x0b")]
    docs += [(500, " ".join(template)), (500, " ".join(passage)), (500, " ".join(passage)), (None, " ".join(template)), (None, " ".join(many[100:140])), (None, " ".join(many[100:140]))]
    docs += [(600, "é ü " * 20), (601, "é ü " * 30), (602, "\x1c\x1d " * 20), (603, "\x1c\x1d " * 20)]
    return docs


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, "x", 1) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, g string, windows int").repartition(4)


@pytest.mark.parametrize("most", [subtrees.GROUP, 7])
def test_like_brute_force(table, most):
    assert rows(subtrees.without_earlier(table, most)) == brute(corpus())


def test_small_blocks_and_pieces(table, monkeypatch):
    monkeypatch.setattr(subtrees, "BLOCK_WORDS", 17)
    monkeypatch.setattr(subtrees, "PIECE_BYTES", 64)
    assert rows(subtrees.without_earlier(table)) == brute(corpus())


def test_prefixes_grow_until_groups_are_small(spark):
    suffixes = [tuple(["a"] * k + [f"b{i}"] * (N - k)) for k in range(N) for i in range(20)] + [("c",) * N] * 30
    table = spark.createDataFrame([(" ".join(s).encode(), k) for k, s in enumerate(suffixes)], "suffix binary, k int")
    small, large = subtrees.grouped(table, 25)
    assert {bytes(r["suffix"]) for r in large.collect()} == {b" ".join([b"c"] * N)}
    assert small.count() == len(suffixes) - 30
    assert max(r["count"] for r in small.groupBy("group").count().collect()) <= 25
    assert small.select("group").distinct().count() > 5


def test_subtree_nodes():
    import numpy as np

    words = np.array([[1, 2, 3], [1, 2, 4], [5, 5, 5], [1, 2, 3], [1, 9, 9]], np.uint64)
    tree = subtrees.Subtree(words)
    found = {d: [sorted(tree.order[a:b].tolist()) for a, b in zip(*tree.nodes(d), strict=True)] for d in (1, 2, 3)}
    assert found == {1: [[0, 1, 3, 4]], 2: [[0, 1, 3]], 3: [[0, 3]]}


def test_very_long_text(spark):
    words = [f"w{i % 5003}" for i in range(300_000)]
    docs = [(1, " ".join(words[:5100])), (2, " ".join(words)), (3, " ".join(words[200_000:210_000]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(subtrees.without_earlier(df)) == brute(docs)


def test_empty_table(spark):
    assert rows(subtrees.without_earlier(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_query_like_sql(spark):
    assert rows_of_spark(op12_substring_dedup(spark, FOLDER)) == rows_of_sql(connect(FOLDER), subtrees.SQL)
