"""Removal of word sequences of a given length that an earlier document holds too.

A word window is the first ``LENGTH`` words of a suffix. Of every window the ``GRAM`` words of
smallest hash are its anchor; equal windows have theirs at the same place, and neighbours mostly
share one, so there is an anchor for every fourth or fifth word. Windows of one anchor are a stretch. Only
anchors whose gram occurs in several documents go on. Stretches that are equal as a whole count as
one, that of the smallest document; all others of them repeat it.

What is left, one of each kind, is split into its suffixes, cut to ``LENGTH`` words. Suffixes are
parted by prefixes of variable length: a prefix that more than ``GROUP`` suffixes share is made
longer, until its group fits in memory. A group is a subtree of the suffix tree, built top-down by
sorting suffixes by word; common prefixes of neighbours are its inner nodes. The nodes of ``LENGTH``
words or more are the deep ones: all suffixes below them begin with one window, and those of any but the
smallest document repeat it. Consecutive windows that repeat make the maximal repeats. Suffixes too many
at full length are one deep node already, and a minimum settles them.

Words are runs without white space; a word of more than ``LONG`` bytes stands in a suffix as its digest.
Null texts have no words. Texts below ``LENGTH`` words keep everything. Null ids count as larger than any
other. Rows that repeat an id are documents of the same rank, so neither removes from the other; they
are told apart by their text. Extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import discard, keep_lean, mix, release, shuffle_width, text_pieces
from docsnap.llm.substrings import sliding
from docsnap.llm.words import PLACE, powers, word_hashes

LENGTH, GRAM = 13, 5
REACH = LENGTH - GRAM + 1
GROUP = 20_000
LEVELS = (3, 6, 9)
LONG = 64
PIECE_BYTES = 1 << 19
BLOCK_WORDS = 1 << 17
LAST_ID = (1 << 63) - 1


def rank_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``d``, the rank of the id, and ``r``, 29 bits that tell texts of one id apart."""
    return docs.select(
        "doc_id", "text", rank_of(F.col("doc_id")).alias("d"), F.shiftrightunsigned(F.xxhash64("text"), 35).alias("r")
    )


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for long texts a part at a time."""
    if len(data) <= 4 * PIECE_BYTES:
        return word_hashes(data, offsets)
    whole, hashes, start = data.tobytes(), [], 0
    while start < len(whole):
        end = whole.find(b" ", start + PIECE_BYTES)
        end = len(whole) if end < 0 else end
        hashes.append(word_hashes(data[start:end], np.array([0, end - start]))[0])
        start = end
    hashes = np.concatenate(hashes)
    return hashes, np.array([0, len(hashes)])  # a piece of that size is one text


def stretches(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The text, first window, number of windows, gram and fingerprint of each stretch.

    Windows are taken in blocks; a stretch that a block cuts is two.
    """
    for begin in range(0, max(0, len(words) - LENGTH + 1), BLOCK_WORDS):
        block = words[begin : begin + BLOCK_WORDS + LENGTH - 1]
        starts = np.arange(len(block) - LENGTH + 1)
        of = np.searchsorted(bounds, starts + begin, "right") - 1
        whole = starts + begin + LENGTH <= bounds[of + 1]
        grams = np.zeros(len(block) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            grams += block[k : k + len(grams)] * PLACE[k]
        grams = mix(grams)
        # The first of the smallest, in one number.
        ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding(ranked, REACH, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts, of, anchor = starts[whole], of[whole], anchor[whole]
        if not len(starts):
            continue
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        low, anchor, of = starts[first], anchor[first], of[first]
        up, down = powers(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * up[: len(block)], out=sums[1:])
        prints = (sums[low + count + LENGTH - 1] - sums[low]) * down[low]
        prints = mix(prints + (count * LENGTH + anchor - low).astype(np.uint64) * PLACE[51])
        yield of, low + begin - bounds[of], count, grams[anchor], prints


def packed(text: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What tells the text, the first window (texts end at 2**31 bytes) and the number of windows, in 63 bits."""
    return text << 34 | low << 4 | count


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window and the number of windows."""
    return at >> 4 & (1 << 30) - 1, at & 15


def text_of(at: Column) -> Column:
    return F.shiftright(at, 34)


def anchor_rows(rows: DataFrame) -> DataFrame:
    """One row per stretch: gram, fingerprint, document, and text, first window and number of windows in one."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["r"].to_numpy()
            for row, _, data, offsets in text_pieces(batch["text"], PIECE_BYTES):
                words, bounds = hashed_words(data, offsets)
                for of, low, count, grams, prints in stretches(words, bounds):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)), pa.array(prints.view(np.int64)),
                            batch["d"].take(pa.array(of + row)), pa.array(packed(texts[of + row], low, count)),
                        ],
                        names=["g", "fp", "d", "at"],
                    )
        release()

    return rows.select("d", "r", "text").mapInArrow(find, "g long, fp long, d long, at long")


def _suffixes(rows: DataFrame) -> DataFrame:
    """The windows of wanted stretches, as words with one blank between them."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch["text"][k].as_py().encode().split()
                words = [w if len(w) <= LONG else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]
                wanted = batch["wanted"][k].values
                places = wanted.field("at").to_numpy(zero_copy_only=False)
                low, count = unpacked(places)
                of = np.repeat(np.arange(len(low)), count)
                number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = (low[of] + number).tolist()
                suffixes = [b" ".join(words[s : s + LENGTH]) for s in start]
                yield pa.RecordBatch.from_arrays(
                    [
                        wanted.field("g").take(pa.array(of)), wanted.field("fp").take(pa.array(of)),
                        pa.repeat(batch["d"][k], len(of)), pa.array(number.astype(np.int32)),
                        pa.array(suffixes, pa.binary()),
                    ],
                    names=["g", "fp", "d", "j", "suffix"],
                )
        release()

    return rows.select("d", "text", "wanted").mapInArrow(cut, "g long, fp long, d long, j int, suffix binary")


def prefix_key(words: int) -> Column:
    """A hash of the first words of a suffix; of more words than there are, of all."""
    # Words may be any bytes, of which Latin-1 makes a string and back.
    whole = F.decode("suffix", "ISO-8859-1")
    return F.xxhash64(F.lit(words), F.substring_index(whole, " ", words))


def grouped(suffixes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes with ``group``, the key of a prefix that at most ``most`` share, and those of
    windows that more than that share, if any."""
    parts, rest = [], suffixes
    for words in (*LEVELS, LENGTH):
        rest = rest.withColumn("group", prefix_key(words))
        heavy = keep_lean(rest.groupBy("group").count().filter(F.col("count") > most).select("group"), "prefixes")
        if heavy.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, rest]), None
        parts.append(rest.join(heavy, "group", "left_anti"))
        rest = rest.join(heavy, "group", "left_semi")
    return reduce(DataFrame.unionByName, parts), rest


class Subtree:
    """A part of the suffix tree: its suffixes in order, and what each shares with the one before.

    Suffixes are rows of word hashes. Runs that share ``depth`` words or more are the leaves below
    one node of that depth.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.order = np.lexsort(words.T[::-1])
        ordered = words[self.order]
        differ = ordered[1:] != ordered[:-1]
        self.shared = np.zeros(len(words), np.int64)
        self.shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end, in order, of the leaves below each inner node of that depth."""
        first = np.flatnonzero(self.shared < depth)
        end = np.append(first[1:], len(self.order))
        inner = end - first > 1
        return first[inner], end[inner]


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows a batch at a time, but for a last group that the next batch may go on with."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        groups = batch["group"].to_numpy()
        if not len(groups):
            continue
        cut = int(np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[-1])
        if cut or (held and held[-1]["group"][-1].as_py() != groups[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


MARKS = "g long, fp long, j int"


def _settled(groups: DataFrame) -> DataFrame:
    """The windows of kinds of stretches that a smaller document holds, from subtrees."""

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            texts = table["suffix"].combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            hashes, _ = word_hashes(data, offsets - offsets[0])
            words = hashes.reshape(-1, LENGTH)
            # A suffix whose first words have no twin is a leaf of its own above the depth asked for.
            whole = mix((words * PLACE[:LENGTH]).sum(axis=1, dtype=np.uint64))
            order = np.argsort(whole, kind="stable")
            same = whole[order[1:]] == whole[order[:-1]]
            twin = np.zeros(len(order), bool)
            twin[order[1:][same]] = twin[order[:-1][same]] = True
            rows = np.flatnonzero(twin)
            tree = Subtree(words[rows])
            documents = table["d"].to_numpy()[rows[tree.order]]
            first, end = tree.nodes(LENGTH)
            if not len(first):
                continue
            sizes = end - first
            inside = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            least = np.repeat(np.minimum.reduceat(documents[inside], np.cumsum(sizes) - sizes), sizes)
            later = pa.array(rows[tree.order[inside[documents[inside] > least]]])
            yield from table.select(["g", "fp", "j"]).take(later).to_batches()
        release()

    columns = groups.select("group", "g", "fp", "j", "d", "suffix")
    dealt = columns.repartition(shuffle_width(groups.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(settle, MARKS)


def _minima(suffixes: DataFrame) -> DataFrame:
    """The same for windows that too many kinds share: each is one deep node."""
    least = suffixes.groupBy("suffix").agg(F.min("d").alias("least"))
    return suffixes.join(least, "suffix").filter("d > least").select("g", "fp", "j")


def repeated_windows(rows: DataFrame, most: int = GROUP) -> DataFrame:
    """``d``, ``r``, ``low``, ``high``: runs of windows (word numbers, end exclusive) that repeat."""
    every = keep_lean(anchor_rows(rows), "word-anchors")
    several = every.groupBy("g").agg(F.min("d").alias("least"), F.max("d").alias("most")).filter("least < most")
    # Written, so that the join below may split a gram of very many anchors.
    again = keep_lean(several.select("g"), "word-grams")
    shared = keep_lean(every.join(again, "g", "left_semi"), "word-stretches")
    discard(every)
    kinds = keep_lean(
        shared.groupBy("g", "fp").agg(
            F.min(F.struct("d", "at")).alias("one"), F.max("d").alias("last")
        ),
        "word-kinds",
    )
    open_grams = kinds.groupBy("g").agg(F.min("one.d").alias("least"), F.max("one.d").alias("most"))
    open_grams = keep_lean(open_grams.filter("least < most").select("g"), "open-grams")
    wanted = (
        kinds.join(open_grams, "g", "left_semi")
        .select("one.d", text_of(F.col("one.at")).alias("r"), F.struct("g", "fp", "one.at").alias("w"))
        .groupBy("d", "r")
        .agg(F.collect_list("w").alias("wanted"))
    )
    texts = rows.join(wanted, ["d", "r"]).dropDuplicates(["d", "r"])
    suffixes = keep_lean(_suffixes(texts), "suffixes")
    small, large = grouped(suffixes, most)
    marks = _settled(small)
    if large is not None:
        marks = marks.unionByName(_minima(large))
    bits = marks.groupBy("g", "fp").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))
    known = (
        kinds.select("g", "fp", F.col("one.d").alias("least"), "last")
        .join(bits, ["g", "fp"], "left")
        .filter("last > least or mask is not null")
        .select("g", "fp", "least", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    )
    known = keep_lean(known, "known-kinds")
    whole = F.expr("shiftleft(1L, cast(at & 15L as int)) - 1L")
    low = F.shiftright("at", 4).bitwiseAND((1 << 30) - 1)
    return (
        shared.join(known, ["g", "fp"])
        .select("d", text_of(F.col("at")).alias("r"), low.alias("low"), F.when(F.col("d") > F.col("least"), whole).otherwise(F.col("mask")).alias("mask"))
        .filter("mask <> 0")
    )


def _cut(rows: DataFrame, id_type: str) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests = [], [], []
            for k in range(batch.num_rows):
                words = (batch["text"][k].as_py() or "").encode().split()
                sizes.append(len(words))
                if batch["windows"][k].is_valid:
                    windows = batch["windows"][k].values
                    low = windows.field("low").to_numpy(zero_copy_only=False)
                    mask = windows.field("mask").to_numpy(zero_copy_only=False)
                    # A window that repeats opens at its first word and closes behind its last.
                    change = np.zeros(len(words) + 1, np.int64)
                    for bit in range(REACH):
                        at = low[(mask >> bit & 1).astype(bool)] + bit
                        np.add.at(change, at, 1)
                        np.add.at(change, at + LENGTH, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [words[w] for w in np.flatnonzero(~gone).tolist()]
                removed.append(sizes[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )
        release()

    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
    return rows.select("doc_id", "text", "windows").mapInArrow(cut, schema)


def without_earlier(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``, one row per document."""
    rows = keyed(docs)
    found = repeated_windows(rows, most)
    windows = found.groupBy("d", "r").agg(F.collect_list(F.struct("low", "mask")).alias("windows"))
    windows = keep_lean(windows, "repeated-windows")
    return _cut(rows.join(windows, ["d", "r"], "left"), dict(docs.dtypes)["doc_id"])


SQL = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as s
  from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from words)),
first as (select s, min(doc_id) as least from windows group by s),
places as (
  select r, list_distinct(flatten(list(range(i, i + 13)))) as gone
  from windows join first using (s) where least < doc_id or (doc_id is null and least is not null) group by r),
kept as (
  select doc_id, len(w) as n_words, case when gone is null then w else
    list_filter(w, lambda x, i: not list_contains(gone, i)) end as k
  from words left join places using (r))
select doc_id, n_words, n_words - len(k) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
