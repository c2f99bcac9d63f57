"""Binary records: exact round trip against the tokenizer, damage, shuffled reads."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from docsnap.llm import records

TEXTS = [
    (3, "One two\tthree  four\n five's <|endoftext|> é é x y z\x1cq"),
    (1, None), (2, ""), (None, "no id"), (7, "word " * 5000), (5, "same"), (5, "same"), (5, "other"),
]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))


def expected(rows, model):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, model):
    docs = spark.createDataFrame([(d, t, "x") for d, t in TEXTS], "doc_id long, text string, start string")
    found = sorted(map(tuple, records.token_records(docs).collect()), key=lambda r: r[1])
    ids = [r[0] for r in found]
    assert ids == [None, 1, 2, 3, 5, 5, 5, 7]
    text_of = {d: t for d, t in TEXTS if d != 5}
    fives = sorted(["same", "same", "other"])
    alone = {r[1:] for t in set(fives) for r in [(0, *expected([(5, t)], model)[0][2:])]}
    assert {r[2:] for r in found if r[0] == 5} == {r[0:] for r in alone}
    start = 0
    for r in found:
        assert r[1] == start
        start += r[2]
        if r[0] != 5:
            assert r[2:] == expected([(r[0], text_of[r[0]])], model)[0][2:]


def test_shuffled_reads_and_damage(spark, model, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(50)], "doc_id long, text string")
    parts = records.write_records(docs, f"file://{tmp_path}/r").collect()
    assert sum(p["n_docs"] for p in parts) == 50
    store = fs.LocalFileSystem()
    part = max(parts, key=lambda p: p["n_docs"])
    with store.open_input_stream(part["path"]) as stream:
        whole = list(records.frames(stream))
    places = [part["n_docs"] - 1, 0, 1]
    for place, (doc_id, ids) in zip(places, records.read_at(store, part["path"], part["index"], places), strict=True):
        assert doc_id == whole[place][0] and ids.tolist() == whole[place][1].tolist()
        assert ids.tolist() == [*model.encode(f"text {doc_id} " * doc_id, add_special_tokens=False).ids, 2]
    data = bytearray(open(part["path"], "rb").read())
    data[-6] ^= 1
    open(part["path"], "wb").write(data)
    with store.open_input_stream(part["path"]) as stream, pytest.raises(ValueError):
        list(records.frames(stream))


def test_empty_table(spark):
    assert records.token_records(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_small_memory_changes_nothing(spark, model, monkeypatch):
    monkeypatch.setattr(records, "CACHED_WORDS", 3)
    rows = [(i, " ".join(f"w{(i * k) % 11}, Ab{k % 5}!" for k in range(40))) for i in range(30)]
    found = sorted(map(tuple, records.token_records(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == expected(rows, model)
