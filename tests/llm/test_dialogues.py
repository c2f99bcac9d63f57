"""The conversation trie against a plain trie of all prefixes."""

import hashlib
import random
import zlib

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from docsnap.llm import dialogues
from docsnap.llm.catalog import op13_conversation_trie

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(table):
    own = {}
    for c, turn, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    return trie({c: (own.get(c - c % 5, [])[: h(c)] + own[c][h(c) :]) for c in own})


def h(c):
    return zlib.crc32(str(c).encode()) % 9


def trie(paths):
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children, below = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    size = lambda node: len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            (
                min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])),
                sum(x not in children for x in below[node]),
                sum((len(members[x]) - 1) * size(x) for x in below[node]),
                hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
            )
            for node, ids in members.items()
        ),
        key=str,
    )


def rows(df):
    assert df.columns == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus():
    rng = random.Random(13)
    texts = ["", "a", "b", "é", None, "<turn>", "x" * 2000]
    table = []
    for c in rng.sample(range(4000), 400):
        for turn in range(rng.randrange(1, 12)):
            table.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "user", "assistant", None]), rng.choice(texts)))
    for c in range(5000, 5200):  # one path for many
        table += [(c, 0, "user", "hi"), (c, 1, "assistant", "hello")]
    for c in range(20_000, 20_060):  # one first turn, long tails
        table += [(c, k, "user", "hi" if k == 0 else f"{c % 7} {k}") for k in range(60)]
    table += [(None, 0, "user", "lost"), (3, 0, "user", "a"), (3, 0, "user", "a"), (60_000, 0, "user", "far"), (100_001, 0, "u", "alone")]
    return table


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, 1, "x") for r in corpus()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, path string").repartition(4)


@pytest.mark.parametrize("turns", [dialogues.PARTITION_TURNS, 40, 1])
def test_like_brute_force(table, turns, monkeypatch):
    monkeypatch.setattr(dialogues, "PIECE_IDS", 1 << 5)
    assert rows(dialogues.conversation_trie(table, turns)) == brute(corpus())


def test_turnless_conversations_are_members_of_the_root(spark):
    convs = [c for c in range(5, 500) if c % 5 and h(c) > 0][:20]
    table = [(c, 0, "user", "own") for c in convs]  # what they begin with is absent, and their only turn is skipped
    found = rows(dialogues.conversation_trie(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
    assert found == brute(table)
    assert [r[1] for r in found] == [0]


def test_one_partition_forest_is_open_on_its_spines():
    leaf = lambda path, k: ([bytes([x]) for x in path], [1] * len(path), 1, k, "e")
    forest = dialogues.Forest([leaf(p, k) for k, p in enumerate([(1, 1), (1, 2, 1), (1, 2, 2), (1, 3), (2,)])])
    assert sorted((n[0], n[3], n[4]) for n in forest.closed) == [(2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 1)]
    assert sorted((n[3], n[6], n[0]) for n in forest.open) == [(0, 0, [0, 1]), (1, 0, [0]), (1, 4, [1]), (2, 0, [0])]


def test_empty_table(spark):
    assert rows(dialogues.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []


def test_query_like_sql(spark):
    assert rows_of_spark(op13_conversation_trie(spark, FOLDER)) == rows_of_sql(connect(FOLDER), dialogues.SQL)
