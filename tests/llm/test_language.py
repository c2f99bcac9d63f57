"""Language identification: held-out accuracy, kernels against sets, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docsnap.llm import catalog, language

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnéü"}


def words(rng, name, n):
    return " ".join("".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def fold(text):
    return " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())


def grams(text):
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def folded(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return language.folded(data, np.array([0, len(data)]))[0]


def test_kernel_is_shared_grams():
    rng = random.Random(1)
    texts = [words(rng, n, 30) for n in ALPHABETS for _ in range(5)]
    model = language.Model([n for n in ALPHABETS for _ in range(5)], [language.exact_grams(folded(t)) for t in texts])
    sets = [grams(fold(t)) for t in texts]
    presence = np.array(
        [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    )
    chosen = model._landmarks([n for n in ALPHABETS for _ in range(5)])
    own = np.array([len(s) for s in sets])
    columns = {int(c): i for i, c in enumerate(model.columns)}
    table, width = model.symbols(), language.ALPHABET + 2
    matrix = np.zeros((len(sets), len(columns)), np.float32)
    for row, found in enumerate(sets):
        for g in found:
            code = sum((int(table[ord(c)]) + (k > 0)) * (1, width, width * (width + 1))[k] for k, c in enumerate(g))
            if code in columns:
                matrix[row, columns[code]] = 1
    assert np.allclose(model.kernel(matrix, own), presence[:, chosen], atol=1e-5)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, n, 20), n) for i, n in enumerate(list(ALPHABETS) * 40)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "123 !! \n", "bb"), (503, "a" * 300_000, None), (None, "ijk lmn", "cc")]
    rows += [(504, "  ABCD, fgh ☃ 日本", "aa"), (504, "  ABCD, fgh ☃ 日本", "aa")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = language.predicted_languages(df).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502))
    assert by[504]["lang_pred"] == "aa" and by[503]["lang_pred"] == "aa" and by[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in found) and by[None]["held_out"]
    kept = language.identified_documents(df, 0.3)
    assert kept.columns == df.columns
    assert {500, 501, 502}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_many_scripts_at_once():
    rng = random.Random(3)
    starts = {"l": 0x61, "r": 0x430, "g": 0x3B1, "h": 0x5D0, "t": 0xE01, "d": 0x905, "k": 0x3042, "z": 0x4E00, "y": 0x5200, "o": 0xAC00}

    def text(name):
        return " ".join("".join(chr(starts[name] + rng.randrange(24)) for _ in range(rng.randrange(2, 7))) for _ in range(30))

    names = [n for n in starts for _ in range(12)]
    model = language.Model(names, [language.exact_grams(folded(text(n))) for n in names])
    assert model.predict(pa.array([text(n) for n in names]))[0] == names


def test_pieces_do_not_matter(monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, n, rng.randrange(1, 40)) for n in ALPHABETS for _ in range(20)]
    model = language.Model([n for n in ALPHABETS for _ in range(20)], [language.exact_grams(folded(t)) for t in texts])
    column = pa.array([*texts, None, "", "7"])
    names, scores = model.predict(column)
    monkeypatch.setattr(language, "PIECE_BYTES", 50)
    again, other = model.predict(column)
    assert names == again and np.allclose(scores, other, atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None), (2, None, "aa")]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predicted_languages(df).collect()
    assert [r["lang_pred"] for r in found] == ["und"] * len(rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in catalog.op1_language(spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found]) > 0.95
