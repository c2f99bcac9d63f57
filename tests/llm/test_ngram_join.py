"""The n-gram join against brute force, with blocks, copies and short texts."""

import random

from docsnap.llm import ngram_join


def shingles(text):
    words = (text or "").split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [
        [j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-12]
        for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((doc_id, min(rows[j][0] for j in seen), len(links[i])))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(120):  # a large group of near copies
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(200, 260):
        rows.append((i, " ".join(base[:15] + [rng.choice(words) for _ in range(60)])))
    rows += [(300 + i, t) for i, t in enumerate([None, "", " \n", "a", "a", "a b", "a  b", "a b c d e", "a b c d e f"])]
    rows += [(400 + i, rows[150][1]) for i in range(30)]
    return rows


def test_like_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    expected = brute(rows)
    assert sorted(map(tuple, ngram_join.ngram_links(df).collect())) == expected
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)  # buckets cut into many blocks
    assert sorted(map(tuple, ngram_join.ngram_links(df).collect())) == expected
    kept = {r["doc_id"] for r in ngram_join.one_of_each_class(df).collect()}
    assert kept == {c for _, c, _ in expected}


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.ngram_links(df).collect()), key=str)
    assert found == sorted([(None, None, None), (1, 1, 2), (1, 1, 2), (2, 2, 0), (None, None, None)], key=str)


def test_empty(spark):
    assert ngram_join.ngram_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []
