"""Removal of byte strings of a given length that occur more than once, across all documents.

Of every string of ``LENGTH`` bytes the ``GRAM``-byte substring of smallest hash is its anchor;
equal strings have their anchor at the same place, and neighbours mostly share one, so about one
position in seventy is an anchor. Only anchors whose gram occurs again go on. An anchor with its
whole surroundings (all strings around it) equal to another's settles all of these at
once; a count does that, however many copies there are.

The other surroundings of a gram, one of each kind, meet in a group. There the suffixes from the
anchor and the reversed prefixes before it are sorted by multikey quicksort to a shallow depth and
by blind tries beyond. The common prefixes of neighbours in both orders tell for each offset which
strings are equal, without comparing pairs. A group too large for a task is settled
string by string instead, by counts on 128-bit hashes.

Texts are their UTF-8 bytes, null is empty, and strings never cross texts. Texts below ``LENGTH``
keep everything. Rows that repeat an id or a whole row count as texts of their own. Extra columns
do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import discard, keep, mix, runs, shuffle_width, text_pieces
from docsnap.llm.suffixes import common_prefixes, deep_shallow_order
from docsnap.llm.words import BASE, BYTE, PLACE, powers

LENGTH, GRAM = 200, 64
BEFORE = LENGTH - GRAM
BLOCK_BYTES = 1 << 18
GROUP_KINDS = 50_000
BATCH_ROWS = 20_000
INTERVALS = "r long, low int, high int"


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the gram at each position; the last positions have none."""
    hashes, width = BYTE[data], 1
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + hashes[width:]
        width *= 2
    return mix(hashes)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest or largest of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and their gram hashes; ``ends`` is the end of each byte's text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data)
    rank = (hashes >> np.uint64(32)).astype(np.uint32)
    least = sliding(rank, BEFORE + 1, np.minimum)
    whole = np.arange(len(least)) + LENGTH <= ends[: len(least)]
    # A position is an anchor if a string around it has no smaller rank.
    least = np.where(whole, least, 0)
    around = np.zeros(len(least) + 2 * BEFORE, np.uint32)
    around[BEFORE : BEFORE + len(least)] = least
    seen = np.zeros(len(around), bool)
    seen[BEFORE : BEFORE + len(least)] = whole
    best = sliding(around, BEFORE + 1, np.maximum)
    any_string = sliding(seen, BEFORE + 1, np.logical_or)
    at = np.flatnonzero((best == rank[: len(best)]) & any_string)
    return at, hashes[at]


def packed(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Position and the bytes at hand on both sides in one number."""
    return at << 16 | left << 8 | right


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor: gram, fingerprint of the surroundings, row key, place."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["r"].to_numpy(zero_copy_only=False)
            for row, end, data, offsets in text_pieces(batch["text"], BLOCK_BYTES):
                for start in range(0, len(data), BLOCK_BYTES):
                    low, high = max(0, start - 2 * LENGTH), min(len(data), start + BLOCK_BYTES + 2 * LENGTH)
                    local = np.clip(offsets - low, 0, high - low)
                    of = np.repeat(np.arange(len(offsets) - 1), np.diff(local))
                    # Texts cut by the block end where they end, so that no string seems whole.
                    ends = (offsets[1:] - low)[of]
                    at, grams = anchors(data[low:high], np.minimum(ends, high - low))
                    inside = (at >= start - low) & (at < start - low + BLOCK_BYTES)
                    at, grams = at[inside], grams[inside]
                    if not len(at):
                        continue
                    begin, finish = (offsets[:-1] - low)[of[at]], ends[at]
                    left, right = np.minimum(at - begin, BEFORE), np.minimum(finish - at, LENGTH)
                    up, down = powers(high - low)
                    sums = np.zeros(high - low + 1, np.uint64)
                    np.cumsum(BYTE[data[low:high]] * up[: high - low], out=sums[1:])
                    prints = (sums[at + right] - sums[at - left]) * down[at - left]
                    sides = (left << 8 | right).astype(np.uint64)
                    prints = mix(prints + sides * PLACE[50])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams.view(np.int64)), pa.array(prints.view(np.int64)),
                            pa.array(keys[row:end][of[at]]), pa.array(packed(at - begin, left, right)),
                        ],
                        names=["g", "fp", "r", "at"],
                    )

    return docs.select("r", "text").mapInArrow(find, "g long, fp long, r long, at long")


def _contexts(rows: DataFrame) -> DataFrame:
    """The surroundings of the wanted anchors of each text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch["text"][k].as_py().encode()
                wanted = batch["wanted"][k].values
                places = wanted.field("at").to_numpy(zero_copy_only=False)
                at, left, right = places >> 16, places >> 8 & 255, places & 255
                pieces = [text[a - b : a + c] for a, b, c in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        wanted.field("g"), wanted.field("n"), wanted.field("hot"),
                        pa.repeat(batch["r"][k], len(pieces)), wanted.field("at"), pa.array(pieces, pa.binary()),
                    ],
                    names=["g", "n", "hot", "r", "at", "around"],
                )

    schema = "g long, n long, hot boolean, r long, at long, around binary"
    return rows.select("r", "text", "wanted").mapInArrow(cut, schema)


def repeated_offsets(group: np.ndarray, around: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each anchor and number of bytes before it, whether that string occurs again.

    ``group`` numbers the groups of equal grams, which are neighbours. Both sides are sorted once
    per group; strings with ``d`` bytes before the anchor are equal if they are in one run of
    common prefixes of at least ``d`` on the left, and of at least the rest on the right.
    """
    size = len(around)
    after = np.zeros((size, LENGTH), np.uint8)
    before = np.zeros((size, BEFORE), np.uint8)
    for row, text in enumerate(around):
        data = np.frombuffer(text, np.uint8)
        before[row, : left[row]] = data[: left[row]][::-1]
        after[row, : right[row]] = data[left[row] :]
    bounds = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [size]))
    orders, prefixes = [], []
    for strings, known in ((after, GRAM), (before, 0)):
        parts = [a + deep_shallow_order(strings[a:b], known) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        order = np.concatenate(parts)
        shared = common_prefixes(strings, order)
        shared[bounds[:-1]] = -1
        orders.append(order)
        prefixes.append(shared)
    found = np.zeros((size, BEFORE + 1), bool)
    on_right, on_left = np.empty(size, np.int64), np.empty(size, np.int64)
    for d in range(BEFORE + 1):
        rows = np.flatnonzero((left >= d) & (right >= LENGTH - d))
        if len(rows) < 2:
            continue
        on_right[orders[0]] = np.cumsum(prefixes[0] < LENGTH - d)
        on_left[orders[1]] = np.cumsum(prefixes[1] < d)
        key = on_right[rows] * (size + 1) + on_left[rows]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        found[rows[order[1:][same]], d] = True
        found[rows[order[:-1][same]], d] = True
    return found


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for table in runs(batches, "g"):
        if table.num_rows > 1:
            held.append(table)
            rows += table.num_rows
        if rows >= BATCH_ROWS:
            yield pa.concat_tables(held)
            held, rows = [], 0
    if held:
        yield pa.concat_tables(held)


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """Intervals of repeated strings at the anchors of groups that fit in a task."""

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            places = table["at"].to_numpy()
            at, left, right = places >> 16, places >> 8 & 255, places & 255
            found = repeated_offsets(table["g"].to_numpy(), table["around"].to_pylist(), left, right)
            found[table["n"].to_numpy() > 1] = False  # settled by count already
            edge = np.zeros((len(found), 1), bool)
            change = np.diff(np.concatenate([edge, found, edge], axis=1).astype(np.int8), axis=1)
            row, first = np.nonzero(change == 1)
            last = np.nonzero(change == -1)[1] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table["r"].to_numpy()[row]),
                    pa.array((at[row] - last).astype(np.int32)),
                    pa.array((at[row] - first + LENGTH).astype(np.int32)),
                ],
                names=["r", "low", "high"],
            )

    columns = ["g", "n", "r", "at", "around"]
    dealt = rows.select(columns).repartition(shuffle_width(rows.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(settle, INTERVALS)


def _counted_strings(rows: DataFrame) -> DataFrame:
    """The same for groups that do not fit: every string is counted by its hash."""

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = batch["r"].to_numpy(), batch["at"].to_numpy()
            for k, text in enumerate(batch["around"].to_pylist()):
                data = np.frombuffer(text, np.uint8)
                starts = np.arange(len(data) - LENGTH + 1)
                up, down = powers(len(data))
                columns = []
                for salt in (0, 1):
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(mix(BYTE[data] + PLACE[52 + salt]) * up[: len(data)], out=sums[1:])
                    columns.append(mix((sums[starts + LENGTH] - sums[starts]) * down[starts]).view(np.int64))
                low = (int(places[k]) >> 16) - (int(places[k]) >> 8 & 255) + starts
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(np.full(len(starts), keys[k])), pa.array(low.astype(np.int32))],
                    names=["w1", "w2", "r", "low"],
                )

    found = keep(rows.select("r", "at", "around").mapInArrow(strings, "w1 long, w2 long, r long, low int"), "strings")
    place = F.xxhash64("r", "low")
    again = found.groupBy("w1", "w2").agg(F.min(place).alias("one"), F.max(place).alias("two")).filter("one <> two")
    return found.join(again, ["w1", "w2"], "left_semi").select("r", "low", (F.col("low") + LENGTH).alias("high"))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """``r``, ``low``, ``high``: stretches of the texts of ``docs`` (r, text) that repeat."""
    every = keep(_anchor_rows(docs), "anchors")
    # Written, so that the join below may split a gram of very many anchors.
    again = keep(every.groupBy("g").count().filter("count > 1").select("g"), "shared-grams")
    shared = keep(every.join(again, "g", "left_semi"), "shared-anchors")
    discard(every)
    kinds = keep(
        shared.groupBy("g", "fp").agg(F.count("*").alias("n"), F.first("r").alias("r"), F.first("at").alias("at")),
        "kinds",
    )
    equal = keep(kinds.filter("n > 1").select("g", "fp"), "equal-surroundings")
    settled = shared.join(equal, ["g", "fp"], "left_semi").select(
        "r",
        ((F.shiftright("at", 16)) - (F.shiftright("at", 8).bitwiseAND(255))).cast("int").alias("low"),
        ((F.shiftright("at", 16)) + (F.col("at").bitwiseAND(255))).cast("int").alias("high"),
    )
    several = kinds.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = (
        kinds.join(several, "g")
        .select("r", F.struct("g", "n", (F.col("kinds") > GROUP_KINDS).alias("hot"), "at").alias("w"))
        .groupBy("r")
        .agg(F.collect_list("w").alias("wanted"))
    )
    around = keep(_contexts(docs.join(wanted, "r")), "surroundings")
    return settled.unionByName(_sorted_groups(around.filter("not hot"))).unionByName(
        _counted_strings(around.filter("hot"))
    )


def _cut(rows: DataFrame, id_type: str) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for k in range(batch.num_rows):
                data = (batch["text"][k].as_py() or "").encode()
                kept, end, gone, count = [], 0, 0, 0
                stretches = batch["stretches"][k]
                if stretches.is_valid:
                    low = stretches.values.field("low").to_numpy(zero_copy_only=False)
                    high = stretches.values.field("high").to_numpy(zero_copy_only=False)
                    order = np.argsort(low, kind="stable")
                    low, high = low[order], np.maximum.accumulate(high[order])
                    first = np.concatenate(([True], low[1:] > high[:-1]))
                    for a, b in zip(low[first].tolist(), high[np.append(first[1:], True)].tolist(), strict=True):
                        kept.append(data[end:a])
                        gone, count, end = gone + b - a, count + 1, b
                kept.append(data[end:])
                sizes.append(len(data))
                removed.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", "stretches").mapInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``, one row per document."""
    rows = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("r"))
    found = repeated_intervals(rows.filter(F.octet_length("text") >= LENGTH).select("r", "text"))
    stretches = keep(found.groupBy("r").agg(F.collect_list(F.struct("low", "high")).alias("stretches")), "stretches")
    return _cut(rows.join(stretches, "r", "left"), dict(docs.dtypes)["doc_id"])
