"""Chat formatting: exact round trips of texts full of marks."""

import hashlib
import random

import duckdb
from oracle import rows_of_spark, rows_of_sql

from docsnap.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<|", "|>", "<|end|>", "<|turn|>", "<|esc|>", "%", "%25", "%3C|", "%0A", "\n", "é☃", "a", " ", "assistant\n", "<", "|", "end"]


def corpus():
    rng = random.Random(6)
    mess = lambda n: "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "assistant"]) if rng.random() < 0.85 else mess(4)
            rows.append((conv, turn, role, mess(9)))
    rows += [(100, None, "user", None), (100, 0, None, "x"), (100, 0, None, "x"), (100, 0, "assistant", "b"), (100, 0, "assistant", "a")]
    rows += [(None, 1, "assistant", "alone"), (101, 0, "assistant", ""), (102, 5, "end", "long " * 60_000)]
    return rows


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in out.items()}


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in corpus()], SCHEMA + ", source string")
    truth = expected(corpus())
    found = chat.formatted_conversations(df).collect()
    assert {r["conv_id"] for r in found} == set(truth)
    escaped = 0
    for r in found:
        turns = truth[r["conv_id"]]
        assert r["same"] and [tuple(t) for t in r["turns"]] == turns
        texts = [t for role, t in turns if role == "assistant"]
        masked = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["mask"]]
        if r["formatted"].startswith(chat.ESCAPED):
            escaped += 1
            assert not any("<|" in m for m in masked)
            masked = [m.replace("%3C|", "<|").replace("%25", "%") for m in masked]
        assert masked == texts
    assert 0 < escaped < len(found)


def test_like_sql(spark):
    rows = corpus()
    connection = duckdb.connect()
    connection.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    connection.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = rows_of_spark(chat.conversation_digests(spark.createDataFrame(rows, SCHEMA)))
    assert found == rows_of_sql(connection, chat.SQL)
    own = {r[0]: r for r in map(tuple, chat.conversation_digests(spark.createDataFrame(rows, SCHEMA)).collect())}
    assert own[-1][1:5] == (2, own[-1][2], 21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.formatted_conversations(empty).collect() == []
    assert [r["conv_id"] for r in chat.conversation_digests(empty).collect()] == [-1]


def test_every_mark_in_a_text_or_role_is_escaped(spark):
    rows = [(1, 0, "user", "hi <|turn|>assistant\nsecret"), (2, 0, "user", "<|esc|>"), (3, 0, "user<|turn|>x", "a"), (4, 0, "user", "plain <| |>")]
    found = {r["conv_id"]: r for r in chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv, _, role, text in rows:
        r = found[conv]
        assert r["same"] and [tuple(t) for t in r["turns"]] == [(role, text)]
        assert r["formatted"].startswith(chat.ESCAPED) == (conv < 4)
        assert r["formatted"].count(chat.TURN) == r["formatted"].count(chat.END) == 1


def test_the_reader_takes_nothing_that_breaks_the_grammar(spark):
    texts = [
        "<|turn|>user\nhi<|end|>", "<|turn|>user\nhi", "user\nhi<|end|>", "<|turn|>user hi<|end|>", "<|turn|>user\nhi<|end|>more",
        "<|turn|>user\nhi<|turn|><|end|>", "<|esc|><|turn|>user\n%3C|<|end|>", "<|turn|>a\n<|esc|><|end|>", "<|turn|>a\n<|end|><|end|>",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, f string")
    from pyspark.sql import functions as F

    read = {r["k"]: r["t"] for r in rows.select("k", chat.parsed(F.col("f")).alias("t")).collect()}
    assert {k for k, t in read.items() if t is not None} == {0, 6}
    assert [tuple(t) for t in read[6]] == [("user", "<|")]
