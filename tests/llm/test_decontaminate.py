"""Decontamination against edit distance by brute force, and its recall by trial."""

import random

import pytest

from docsnap.llm import decontaminate as D


def edits(item, text):
    """Least edit distance of item to any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    items = [(i, words(rng, rng.randrange(14, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "tiny item"), (93, "somewhat longer, yet short")]
    docs = []
    for i in range(60):
        text = words(rng, rng.randrange(5, 120))
        if i % 3 == 0:
            item = items[i % 12][1]
            if i % 2:
                item = item.upper().replace(" ", ",  ")
            if i % 9 == 0:
                item = item.replace("a", "", 2)
            text = text + " " + item + " " + words(rng, 20)
        docs.append((i, text))
    docs += [(70, None), (71, ""), (72, "a tiny, ITEM here"), (73, "tinyitem"), (76, "so what longer yet shor"), (77, "longer yet short"), (74, items[3][1]), (74, items[3][1])]
    docs += [(None, items[5][1]), (75, words(rng, 30_000) + " " + items[6][1])]
    return docs, items


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        item, text = words(rng, 4).encode(), words(rng, rng.randrange(12)).encode() if rng.random() < 0.9 else b""
        masks = {}
        for k, byte in enumerate(item):
            masks[byte] = masks.get(byte, 0) | 1 << k
        assert D.least_edits(item, masks, text) == edits(item, text)


def test_like_brute_force(spark):
    docs, items = corpus()
    expected = set()
    for doc_id, text in docs:
        plain = D.plain_text(text or "")
        for item_id, item in items:
            item = D.plain_text(item or "")
            if len(plain) > 10_000:
                if item and item in plain:
                    expected.add((doc_id, item_id, 0))
            elif 0 < len(item) < D.WORDS:
                if plain and (d := edits(b" " + item + b" ", b" " + plain + b" ")) <= int(D.MAX_DISTANCE * len(item)):
                    expected.add((doc_id, item_id, d))
            elif item and (d := edits(item, plain)) <= int(D.MAX_DISTANCE * len(item)):
                expected.add((doc_id, item_id, d))
    df = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = {tuple(r) for r in D.contaminated(df, table).collect()}
    assert found == expected and len(found) > 20
    clean = D.clean_documents(df, table)
    assert clean.columns == df.columns
    bad = {d for d, _, _ in expected}
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(
        str((d, t, "e")) for d, t in docs if d not in bad
    )


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.contaminated(df, table).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    assert {tuple(r) for r in D.contaminated(df, table).collect()} == whole


def test_recall():
    items = [t for _, t in corpus()[1][:12]]
    assert D.expected_recall(items, 0.05) >= 0.98
    assert D.expected_recall(items, D.TARGET_DISTANCE) >= 0.9


@pytest.mark.parametrize("size", [12, 36, 60, 70, 84, 100, 120, 150, 190, 300])
def test_recall_at_the_accepted_distance(size):
    """At least 0.9 in every class of lengths, and everything where items are short."""
    rng = random.Random(size)
    items = [words(rng, size)[:size].strip() for _ in range(40)]
    assert D.TARGET_DISTANCE == D.MAX_DISTANCE
    assert D.expected_recall(items, D.MAX_DISTANCE, 150) >= (0.9 if size >= D.SHORT else 1)


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("ΟΔΥΣΣΕΥΣ", "ο παλιός ΟΔΥΣΣΕΥΣ εδώ"),
        ("ΠΡΩΤΟΣ ΛΟΓΟΣ", "ΠΡΩΤΟΣ ΛΟΓΟΣ"),
        ("İYİ GÜNLER DİLERİM SİZE İSTANBULDAN", "so: İYİ GÜNLER DİLERİM SİZE İSTANBULDAN."),
        ("ΠΡΩΤΟΣ ΛΟΓΟΣ " * 12, "και ΠΡΩΤΟΣ ΛΟΓΟΣ " + "ΠΡΩΤΟΣ ΛΟΓΟΣ " * 11),
    ],
)
def test_verbatim_copies_in_other_scripts(item, text):
    assert list(D.Items([(1, item)], D.MAX_DISTANCE).matches(D.pa.array([text]))) == [(0, 1, 0)]


@pytest.mark.parametrize(("size", "edit"), [(31, 6), (33, 6), (63, 12), (64, 12)])
def test_edits_of_items_around_the_border(size, edit):
    rng = random.Random(size)
    item = words(rng, 20)[:size].replace(" ", "q")
    text = item[:10] + "Z" * 1 + item[11:]
    assert list(D.Items([(1, item)], D.MAX_DISTANCE).matches(D.pa.array(["a b " + text + " c"]))) == [(0, 1, 1)]
    assert int(D.MAX_DISTANCE * size) == edit


def test_short_items_across_areas_and_texts():
    rng = random.Random(4)
    item = "a short item of few words"
    texts = []
    for k in range(60):
        before = words(rng, 80)[: 200 + k]
        texts.append(before + " " + item.replace("few", "fev") + " end")
    texts += ["a short item", "of few words"]
    assert list(D.Items([(1, item)], 0.2).matches(D.pa.array(texts))) == [(k, 1, 1) for k in range(60)]


def test_very_long_item():
    import resource

    rng = random.Random(100)
    item = words(rng, 18_000)[:100_000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(D.Items([(1, item)], 0.2).matches(D.pa.array(["so " + item.replace("a", "", 50) + " end", words(rng, 2000)])))
    assert [(r, i) for r, i, _ in found] == [(0, 1)] and found[0][2] <= 50
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_grams_drop_nothing_within_reach():
    rng = random.Random(8)
    for _ in range(200):
        item = words(rng, 20).encode()
        text = bytearray(item)
        for _ in range(rng.randrange(int(0.2 * len(item)) + 1)):
            place = rng.randrange(len(text))
            text[place : place + rng.randrange(2)] = rng.choice([b"", b"q", b"e"])
        block = D.Items([(1, item.decode())], D.MAX_DISTANCE)
        before = words(rng, 30).encode()[-block.most[0] :]
        stretch = D.np.frombuffer(before + bytes(text) + b" and so on", D.np.uint8)
        near = D.least_edits(item, block.masks[0], stretch.tobytes()) <= block.most[0]
        assert block.possible(0, block.most[0] - len(before), stretch) or not near


@pytest.mark.parametrize("item", ["internationalization matters a lot", "unquestionably reproducible experiments done"])
@pytest.mark.parametrize("before", range(4))
def test_verbatim_item_behind_any_number_of_words(item, before):
    assert 32 <= len(item) <= 45
    text = " ".join(["so", "it", "was", "then"][:before] + [item, "and so on"])
    block = D.Items([(1, item)], D.MAX_DISTANCE)
    assert list(block.matches(D.pa.array([text]))) == [(0, 1, 0)]


def test_texts_without_blanks():
    item = "下列哪一种语言没有空格也能被正确地找到"
    block = D.Items([(1, item), (2, "短句子")], D.MAX_DISTANCE)
    texts = ["我们先说几句别的话" + item + "然后继续", "前面，" + item + "。后面", "这里有短句子在中间", "没有关系的一段文字而已"]
    assert set(block.matches(D.pa.array(texts))) == {(0, 1, 0), (1, 1, 0), (2, 2, 0)}
    block = D.Items([(1, "下列哪一种语言，没有空格也能被正确地找到")], D.MAX_DISTANCE)
    assert set(block.matches(D.pa.array(["下列哪一种语言 没有空格也能被正确地找到"]))) == {(0, 1, 0)}
    item = "abcdefghijklmnopqrstuvwxyz0123456789abc"
    assert set(D.Items([(1, item)], 0.2).matches(D.pa.array(["x" * 50 + item]))) == {(0, 1, 0)}


@pytest.mark.parametrize("side", [0, 1])
def test_empty_tables(spark, side):
    docs, items = corpus()
    df = spark.createDataFrame(docs if side else [], "doc_id long, text string")
    table = spark.createDataFrame([] if side else items, "item_id long, text string")
    assert D.contaminated(df, table).collect() == []
    assert D.clean_documents(df, table).count() == df.count()
