"""Benchmark items in documents, by edit distance.

Texts are lower-cased and runs of anything but letters and digits become one space, in all scripts;
letters beyond ASCII keep their UTF-8 bytes. An item is found where some stretch of a document is within
``max_distance`` edits per byte of it.

A random walk reads a window: at each step it notes the byte it stands on and, as a random
table says for that step and byte, moves on or stays. Two windows a few edits apart fall into
step again after each edit, so their notes differ in few places. Bits of the notes are sampled
into a key, several keys per walk, and equal keys make candidates. Windows start at every word of a
document and of an item, in scripts from U+0800 on, many of which have no blanks, and behind ``LONG`` bytes
without a blank at every letter, so an item is met from many of its words, and it takes one of these to
pass. Windows grow with the items but stay shorter: at the accepted distance a window as long as an item
holds an edit in every fifth byte, and no key of useful length survives that. ``CLASSES`` gives walks and
keys by length of item, as many as measured recall at ``TARGET_DISTANCE`` asks for: ``expected_recall``
gives it by trial. A candidate with too few grams of the item near their places cannot be within reach;
every other is verified by exact edit distance.

Items of fewer than ``SHORT`` bytes have too few windows for that. They are searched for in all texts
without a loss: areas of text that hold enough of an item's grams are verified. Below ``WORDS`` bytes
the blanks around an item belong to it (none beside a letter of a script without blanks).

Items are spread to the tasks in blocks of bounded size, one pass over the documents per block. The distance
is the least over the places that are candidates.

Null and empty texts contain nothing, null and empty items are nowhere. Rows that repeat a
document id count as one document; null ids make a row of their own. Empty tables give no rows.
"""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import parts, remembered, text_pieces

MAX_DISTANCE = TARGET_DISTANCE = 0.2
#: Items below so many bytes: with so many walks of so many steps, and so many keys of so many notes
#: each; by measured recall. All classes share the walks, and the first ``EARLY`` steps of each.
CLASSES = ((80, 20, 18, 5, 13), (112, 8, 22, 6, 15), (176, 6, 24, 3, 16), (1 << 60, 3, 28, 3, 16))
EARLY, EARLY_NOTES = 12, 8
STEPS = max(steps for _, _, steps, _, _ in CLASSES)
SHORT, WORDS, GRAM, LONG = 64, 32, 3, 32
#: Bytes of text in which the grams of a short item are counted; longer than such an item with its edits.
AREA = 256
#: Items above are tested for grams without regard to places, which needs no matrix.
WIDE = 4096
#: The lead byte of U+0800, the first of three bytes.
UNSPACED = 0xE0
#: Thai to Tibetan, Burmese, Khmer, Chinese and Japanese.
NO_BLANKS = ((0xE00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
PIECE_BYTES = 1 << 20
BLOCK_BYTES = 32 << 20
#: Places of a text whose walks go on together, so that they stay in a processor's cache.
CHUNK = 1 << 14
ODD, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(3)
SYMBOLS = 64
#: Letters, digits and the blank stay apart; bytes beyond ASCII share the other 27 symbols.
SYMBOL = np.zeros(256, np.uint16)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = np.arange(27, 37)
SYMBOL[128:] = 37 + np.arange(128) * 11 % 27

PLAIN = np.full(256, 32, np.uint8)
PLAIN[48:58] = np.arange(48, 58)
PLAIN[97:123] = PLAIN[65:91] = np.arange(97, 123)
PLAIN[128:] = np.arange(128, 256)

SEED = 5


class Walk:
    """A random walk as tables by pair of steps and pair of symbols.

    ``early`` and ``moves`` (what follows) give the bytes to move on in the lowest two bits; above
    them ``early`` has what the sampled notes of the pair add to the early key, and ``notes`` has the
    same for each class and each of its keys. All keys of a walk start with the early one.
    """

    def __init__(self, number: int) -> None:
        rng = np.random.Generator(np.random.PCG64((SEED, number)))
        # Who stays at a step moves at the next, so that no walk stands still and repeats its notes.
        goes = rng.integers(0, 2, (STEPS // 2, SYMBOLS)).astype(bool)
        values = rng.integers(0, 1 << 62, (STEPS, SYMBOLS), np.uint64) << np.uint64(2)
        here, there = np.arange(SYMBOLS)[:, None], np.arange(SYMBOLS)[None, :]

        def table(pair: int, sampled: np.ndarray) -> np.ndarray:
            first = goes[pair][:, None] & (there >= 0)
            second = np.where(first, there, here)
            ahead = first.astype(np.uint64) + ~goes[pair][second]
            one, two = (values[2 * pair + k] * sampled[2 * pair + k] for k in (0, 1))
            return ((one[:, None] ^ two[second]) | ahead).T.ravel()  # the second symbol counts more

        def sample(low: int, high: int, notes: int) -> np.ndarray:
            sampled = np.zeros(STEPS, np.uint64)
            sampled[low + rng.choice(high - low, min(notes, high - low), False)] = 1
            return sampled

        before = sample(0, EARLY, EARLY_NOTES)
        self.early = [table(pair, before) for pair in range(EARLY // 2)]
        self.moves = [table(pair, np.zeros(STEPS, np.uint64)) for pair in range(EARLY // 2, STEPS // 2)]
        self.notes = []
        for _, walks, steps, keys, notes in CLASSES:
            samples = [sample(EARLY, steps, notes - EARLY_NOTES) for _ in range(keys if number < walks else 0)]
            self.notes.append([[table(pair, x) & ~THREE for pair in range(EARLY // 2, steps // 2)] for x in samples])

    def begin(self, pairs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks from the places ``at``: where they are after the early steps, and their early keys."""
        key = np.zeros(len(at), np.uint64)
        for table in self.early:
            step = table.take(pairs.take(at))
            key ^= step
            step &= THREE
            at = at + step.view(np.int64)
        return at, key & ~THREE

    def go_on(self, pairs: np.ndarray, at: np.ndarray, early: np.ndarray, classes: list[int]) -> list[list[np.ndarray]]:
        """All keys of walks that are there after the early steps, for each of some classes."""
        keys = [[early.copy() for _ in self.notes[c]] for c in classes]
        for pair, moves in enumerate(self.moves):
            seen = pairs.take(at)
            for c, of_class in zip(classes, keys, strict=True):
                if pair < (CLASSES[c][2] - EARLY) // 2:
                    for key, tables in zip(of_class, self.notes[c], strict=True):
                        key ^= tables[pair].take(seen)
            at = at + (moves.take(seen) & THREE).view(np.int64)
        return keys


def symbols(text: np.ndarray) -> np.ndarray:
    """Each byte and the next as a pair of symbols in one number; the last byte has none."""
    small = SYMBOL[text]
    return (small[:-1] | small[1:] << 6).astype(np.int64)


def separators() -> np.ndarray:
    """Of each code point beyond ASCII whether it is blank: not letter, mark or digit."""
    memory = sys.modules.setdefault("docsnap_separators", types.ModuleType("docsnap_separators"))
    if not hasattr(memory, "table"):
        memory.table = _separators()
    return memory.table


def _separators() -> np.ndarray:
    return np.array([k > 127 and unicodedata.category(chr(k))[0] in "ZPSC" for k in range(0x110000)])


def blanked(data: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes with separators beyond ASCII as blanks."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return data
    length = 2 + (data[lead] >= UNSPACED) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> length)
    for k in range(1, 4):
        more = length > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
    blank = separators()[code]
    data = data.copy()
    for k in range(4):
        data[lead[blank & (length > k)] + k] = 32
    return data


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain bytes with single spaces, and the offsets of the texts in them."""
    plain = PLAIN[blanked(data)]
    keep = plain != 32
    keep[1:] |= plain[:-1] != 32
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    keep[inner] = True
    places = np.concatenate(([0], np.cumsum(keep)))
    return plain[keep], places[offsets]


def plain_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Plain bytes of a column of texts in pieces: first row, bytes, offsets of the texts."""
    for row, _, data, offsets in text_pieces(pc.utf8_lower(column), PIECE_BYTES):
        yield row, *normalised(data, offsets)


def plain_text(text: str) -> bytes:
    return b"".join(data.tobytes() for _, data, _ in plain_pieces(pa.array([text], pa.string()))).strip()


class KeyFilter:
    """Which keys may be among the given ones: a table of so many places that few others are."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(12, int(64 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self._place(keys)] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(2)) * ODD >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table.take(self._place(keys)))


def grams(text: np.ndarray) -> np.ndarray:
    text = text.astype(np.int32)
    return text[:-2] | text[1:-1] << 8 | text[2:] << 16


def word_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    word = (text != 32) & (text != 0)
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[offsets < len(text)]
    first[inner] = word[inner]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
    inside = (np.arange(len(text)) - begin >= LONG) & ((text & 0xC0) != 0x80)
    return np.flatnonzero(first | word & (inside | (text >= UNSPACED)))


def spaced(letter: str) -> bool:
    """Whether words of this letter's script have blanks around them."""
    return not any(low <= ord(letter) <= high for low, high in NO_BLANKS)


def least_edits(item: bytes, masks: dict[int, int], text: bytes, most: int | None = None) -> int:
    """The smallest edit distance of the item to any stretch of the text, bit-parallel.

    With ``most`` it ends where the rest of the text cannot bring the distance down to that.
    """
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best = score
    # The score falls by one a byte at most.
    bar = len(text) + (len(item) if most is None else most)
    for byte in text:
        if score > bar:
            break
        bar -= 1
        equal = masks.get(byte, 0)
        across = equal | minus
        down = (((equal & plus) + plus) ^ plus) | equal
        rise = minus | (full & ~(down | plus))
        fall = plus & down
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        plus = fall | (full & ~(across | rise))
        minus = rise & across
    return best


def byte_masks(text: bytes) -> dict[int, int]:
    """For each byte value the places it has in the text, as bits."""
    masks: dict[int, int] = {}
    for k, byte in enumerate(text):
        masks[byte] = masks.get(byte, 0) | 1 << k
    return masks


class ShortItem:
    """A short item, and what its grams tell of a text that may hold it."""

    def __init__(self, item_id, text: bytes, most: int) -> None:
        self.item_id, self.most, self.text = item_id, most, text
        if len(text) < WORDS:
            letters = text.decode()
            self.text = b" " * spaced(letters[0]) + text + b" " * spaced(letters[-1])
        self.masks = byte_masks(self.text)
        all_grams = grams(np.frombuffer(self.text, np.uint8))
        self.grams, self.counts = np.unique(all_grams, return_counts=True)
        self.needed = len(all_grams) - GRAM * most


class Items:
    """The items of one block, with the keys of their windows."""

    def __init__(self, rows: list[tuple], max_distance: float) -> None:
        texts = [(i, plain_text(t)) for i, t in rows if t]
        self.items = [(i, t) for i, t in texts if len(t) >= SHORT]
        self.short = [ShortItem(i, t, int(max_distance * len(t))) for i, t in texts if 0 < len(t) < SHORT]
        self.short_grams = np.unique(np.concatenate([s.grams for s in self.short])) if self.short else None
        self.most = [int(max_distance * len(t)) for _, t in self.items]
        self.masks = [byte_masks(text) for _, text in self.items]
        numbers, starts, joined, offset = [], [], [], 0
        for number, (_, text) in enumerate(self.items):
            data = np.frombuffer(text, np.uint8)
            places = word_starts(data, np.zeros(1, np.int64))
            places = places[(places <= len(text) - STEPS) | (places == 0)]
            numbers.append(np.full(len(places), number))
            starts.append(places + offset)
            joined += [text, bytes(STEPS + 1)]
            offset += len(text) + STEPS + 1
        text = np.frombuffer(b"".join([*joined, bytes(STEPS + 1)]), np.uint8)
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        origin = np.concatenate(([0], np.cumsum([len(t) + STEPS + 1 for _, t in self.items])))
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.grams = [grams(np.frombuffer(t, np.uint8)) for _, t in self.items]
        pairs = symbols(text)
        inside = start - origin[number]
        bounds = np.array([0, *(below for below, *_ in CLASSES)])
        size_class = np.searchsorted(bounds, sizes, "right")[number] - 1
        self.classes = np.unique(size_class).tolist()
        self.walks = []
        for w in range(max((CLASSES[c][1] for c in self.classes), default=0)):
            walk, classes = Walk(w), [c for c in self.classes if w < CLASSES[c][1]]
            mine = np.flatnonzero(np.isin(size_class, classes))
            at, early = walk.begin(pairs, start[mine])
            known = []
            for c, keys in zip(classes, walk.go_on(pairs, at, early, classes), strict=True):
                of_class = size_class[mine] == c
                for key in keys:
                    order = np.argsort(key[of_class], kind="stable")
                    rows = mine[of_class][order]
                    known.append((KeyFilter(np.unique(key[of_class])), key[of_class][order], number[rows], inside[rows]))
            self.walks.append((walk, classes, KeyFilter(np.unique(early)), known))

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of item number and the place in the text where the item would begin."""
        found = [np.zeros((2, 0), np.int64)]
        pairs = symbols(text)
        for begin in range(0, len(starts), CHUNK):
            chunk = starts[begin : begin + CHUNK]
            for walk, classes, early, known in self.walks:
                at, key = walk.begin(pairs, chunk)
                live = early(key)
                keys = [key for of_class in walk.go_on(pairs, at[live], key[live], classes) for key in of_class]
                for key, (late, keys_known, numbers, inside) in zip(keys, known, strict=True):
                    likely = late(key)
                    if not len(likely):
                        continue
                    here, key = chunk[live[likely]], key[likely]
                    low, high = np.searchsorted(keys_known, key, "left"), np.searchsorted(keys_known, key, "right")
                    many = high - low
                    which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    found.append(np.stack([numbers[which], np.repeat(here, many) - inside[which]]))
        return np.unique(np.concatenate(found, axis=1), axis=1).T

    def possible(self, number: int, shift: int, text: np.ndarray) -> bool:
        """False only where too few grams of the item are near their places in the text.

        An edit spoils at most ``GRAM`` of them and shifts the others by one at most. The text begins
        ``shift`` bytes behind the first place where a match may begin.
        """
        own, most = self.grams[number], self.most[number]
        needed = len(own) - GRAM * most
        if needed <= 0:
            return True
        if len(own) > WIDE:
            return np.count_nonzero(np.isin(own, grams(text))) >= needed
        there = np.full(len(own) + 4 * most, -1, np.int32)
        given = grams(text)[: len(there) - most - shift]
        there[most + shift : most + shift + len(given)] = given
        # All shifts at once, as overlapping rows of one array.
        near = np.ndarray((4 * most + 1, len(own)), np.int32, there, 0, (4, 4))
        return np.count_nonzero((near == own).any(axis=0)) >= needed

    def matches(self, column: pa.Array) -> Iterator[tuple[int, object, int]]:
        """Row, item and distance of every item found, in a column of texts."""
        for row, text, bounds in plain_pieces(column):
            if self.items:
                yield from ((row + r, i, d) for r, i, d in self._near(text, bounds))
            if self.short:
                yield from ((row + r, i, d) for r, i, d in self._short(text, bounds))

    def _near(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, object, int]]:
        starts = word_starts(text, bounds)
        padded = np.concatenate([text, np.zeros(STEPS + 1, np.uint8)])
        likely: dict[tuple[int, int], list[int]] = {}
        for number, begin in self.candidates(padded, starts).tolist():
            item, most = self.items[number][1], self.most[number]
            middle = min(max(begin + len(item) // 2, 0), len(text) - 1)
            row = int(np.searchsorted(bounds, middle, "right")) - 1
            low = max(begin - most, int(bounds[row]))
            high = min(begin + len(item) + most, int(bounds[row + 1]))
            if self.possible(number, low - begin + most, text[low:high]):
                likely.setdefault((row, number), []).append(begin)
        for (row, number), begins in likely.items():
            item, most = self.items[number][1], self.most[number]
            least, first, last = len(item), begins[0], begins[0]
            # Candidates whose stretches overlap much are verified as one longer stretch.
            for begin in [*begins[1:], None]:
                if begin is not None and begin - last <= most:
                    last = begin
                    continue
                low = max(first - most, int(bounds[row]))
                high = min(last + len(item) + most, int(bounds[row + 1]))
                least = min(least, least_edits(item, self.masks[number], text[low:high].tobytes(), most))
                first = last = begin
            if least <= most:
                yield row, self.items[number][0], least

    def _short(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, object, int]]:
        """Short items, blank by blank: every area with enough of an item's grams is verified."""
        rows = [text[a:b].tobytes().strip() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        whole = b"".join(b" " + r + b" \0" for r in rows) + bytes(GRAM)
        begins = np.concatenate(([0], np.cumsum([len(r) + 3 for r in rows])))
        codes = grams(np.frombuffer(whole, np.uint8))
        known = np.flatnonzero(np.isin(codes, self.short_grams))
        known = known[np.argsort(codes[known], kind="stable")]
        codes = codes[known]
        areas = -(-len(whole) // AREA)
        for item in self.short:
            present = np.zeros((len(item.grams), areas + 1), bool)
            low, high = (np.searchsorted(codes, item.grams, side) for side in ("left", "right"))
            for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                present[k, known[a:b] // AREA] = True
            # A match that begins in an area may end in the next.
            enough = item.counts @ (present[:, :-1] | present[:, 1:]) >= item.needed
            least: dict[int, int] = {}
            for area in np.flatnonzero(enough).tolist():
                end = min((area + 1) * AREA + len(item.text) + item.most, len(whole))
                for row in range(int(np.searchsorted(begins, area * AREA, "right")) - 1, len(rows)):
                    if begins[row] >= end:
                        break
                    part = whole[max(area * AREA, begins[row]) : min(end, begins[row + 1] - 1)]
                    distance = least_edits(item.text, item.masks, part, item.most)
                    if distance <= item.most:
                        least[row] = min(distance, least.get(row, distance))
            yield from ((row, item.item_id, distance) for row, distance in least.items())


def _prepared(rows: tuple, max_distance: float) -> Items:
    return remembered("items", (rows, max_distance), lambda: Items(list(rows), max_distance))


def _blocks(items: DataFrame) -> Iterator[tuple]:
    """The items in blocks of at most ``BLOCK_BYTES``, or of one item each, as rows of id and text."""
    rows = items.select("item_id", "text").filter("text is not null").distinct()
    size, blocks = F.octet_length("text") + 16, 1

    def block() -> Column:
        return F.pmod(F.xxhash64("item_id", "text", F.lit(blocks)), F.lit(blocks))

    while not (
        rows.groupBy(block().alias("block"))
        .agg(F.sum(size).alias("size"), F.count("*").alias("items"))
        .filter((F.col("size") > BLOCK_BYTES) & (F.col("items") > 1))
        .isEmpty()
    ):
        blocks *= 2
    for number in range(blocks):
        yield tuple(sorted({(r[0], r[1]) for r in rows.filter(block() == number).collect()}, key=str))


def contaminated(docs: DataFrame, items: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``item_id`` and ``distance`` (edits, the least) of items found in documents."""
    spark, found = docs.sparkSession, None
    kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, distance int"
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _prepared(sent.value, max_distance)
            for batch in parts(batches):
                rows = list(block.matches(batch["text"]))
                if rows:
                    at, ids, distances = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(at)), pa.array(ids), pa.array(distances, pa.int32())],
                        names=["doc_id", "item_id", "distance"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(find, schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean_documents(docs: DataFrame, items: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The documents that contain no item; columns as they were, and no shuffle."""
    spark = docs.sparkSession
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _prepared(sent.value, max_distance)
            for batch in parts(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in block.matches(batch["text"])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def expected_recall(items: list[str], distance: float = TARGET_DISTANCE, trials: int = 200, seed: int = 0) -> float:
    """The share of items found after random edits of that many bytes, by trial.

    Where edits break letters of several bytes, a text may end up farther off than is accepted;
    such trials are drawn again.
    """
    rng = np.random.default_rng(seed)
    block, done, hits = Items(list(enumerate(items)), MAX_DISTANCE), 0, 0
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    known = [(*item, masks, most) for item, masks, most in zip(block.items, block.masks, block.most, strict=True)]
    known += [(x.item_id, x.text, x.masks, x.most) for x in block.short]
    for trial in range(10 * trials):
        number, item, masks, most = known[trial % len(known)]
        text = list(item.strip())
        for _ in range(int(distance * len(text))):
            place, kind = rng.integers(len(text)), rng.integers(3)
            text[place : place + int(kind != 0)] = [int(rng.choice(letters))] * int(kind != 2)
        whole = "so it begins " + bytes(text).decode(errors="replace") + " and ends"
        if least_edits(item, masks, b" " + plain_text(whole) + b" ") > most:
            continue
        done += 1
        hits += any(i == number for _, i, _ in block.matches(pa.array([whole])))
        if done == trials:
            break
    return hits / max(done, 1)
