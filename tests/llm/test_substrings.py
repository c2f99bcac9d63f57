"""Repeated strings against brute force, and the sorting by itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docsnap.llm import substrings
from docsnap.llm.suffixes import common_prefixes, deep_shallow_order

LENGTH = substrings.LENGTH


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[i : i + LENGTH] for _, b in data for i in range(len(b) - LENGTH + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if counts[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcé dz") for _ in range(n))
    passages = [noise(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = []
    for i in range(150):
        text = noise(rng.randrange(0, 500))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            if rng.random() < 0.3:  # an edit somewhere in it
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            text += p[rng.randrange(20) :] + noise(rng.randrange(0, 300))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "short"), (203, "ab" * 600), (204, "x" * 199), (205, "x" * 200), (206, "y" * 201)]
    rows += [(207, rows[3][1]), (207, rows[3][1]), (208, passages[4]), (None, passages[4]), (209, noise(40_000) + passages[5])]
    return rows


@pytest.fixture(scope="module")
def expected():
    return brute(corpus())


@pytest.mark.parametrize("kinds", [50_000, 3])
def test_like_brute_force(spark, expected, monkeypatch, kinds):
    monkeypatch.setattr(substrings, "GROUP_KINDS", kinds)
    df = spark.createDataFrame([(d, t, 1) for d, t in corpus()], "doc_id long, text string, r int")
    assert sorted(map(tuple, substrings.without_repeats(df).collect()), key=str) == expected


def test_anchors_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.repeat([1200, 1399, 5000], [1200, 199, 3601])
    at, _ = substrings.anchors(data, ends)
    ranks = (substrings.gram_hashes(data) >> np.uint64(32)).astype(np.int64)
    expected = set()
    for start in range(len(data) - LENGTH + 1):
        if start + LENGTH <= ends[start]:
            window = ranks[start : start + substrings.BEFORE + 1]
            expected |= {start + int(k) for k in np.flatnonzero(window == window.min())}
    assert set(at.tolist()) == expected


def test_deep_shallow_order():
    rng = random.Random(7)
    for first in (0, 8):
        base = bytes(rng.choice(b"ab") for _ in range(90))
        rows = [base[:first] + bytes(rng.choice(b"ab") for _ in range(90 - first)) for _ in range(50)]
        for _ in range(200):
            text = bytearray(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(first, 90)] = rng.choice(b"abc\0")
            rows.append(bytes(text))
        strings = np.stack([np.frombuffer(r, np.uint8) for r in rows])
        order = deep_shallow_order(strings, first)
        assert sorted(order.tolist()) == list(range(len(rows)))
        assert [rows[k] for k in order] == sorted(rows)
        shared = common_prefixes(strings, order)
        for n in range(1, len(rows)):
            a, b = rows[order[n - 1]], rows[order[n]]
            assert shared[n] == next((k for k in range(90) if a[k] != b[k]), 90)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
