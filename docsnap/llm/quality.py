"""Quality scores from random-indexing word vectors and a small calibrated network.

Texts are cut into runs of letters, of digits and of other signs. Every word has a fixed sparse index vector of a
few random signs; a word's context vector is the sum of the index vectors of its neighbours, over all
documents, and of one for its own shape (small, capital, upper, number, sign). Words share ``BUCKETS`` by hash,
so the table has one size whatever the corpus. A document is the mean and the spread of its words' vectors,
rare words weighing more, and its length. A network of two layers, fitted with numpy on at most
``LABELLED`` labelled rows, gives a logit; its temperature is fitted on rows kept from the training.

The table is summed per task, then in two steps over blocks of words, so nothing but a table of fixed size
ever reaches one task or the driver.

Empty and null texts have no words and get the score the network gives to none. Without labels of both classes
every score is the share of the good, or a half. Labels that are null or repeated for an id do not
count more than once. Repeated rows are scored alike; null ids are scored, never learned from. Extra columns do
not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import keep, mix, parts, shuffle_width, text_pieces
from docsnap.llm.words import BYTE, powers

BUCKETS, DIMENSIONS, SIGNS, REACH = 1 << 13, 48, 3, 2
SHAPES = 6
BLOCKS = 64
RARE = 1e-3
LABELLED, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 20_000, 32, 60, 128, 3e-3, 1e-4
GOOD = 0.7
FOLDS, HELD_OUT = 4, 2
PIECE_BYTES = 1 << 19
FEATURES = 2 * DIMENSIONS + 2

KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(6))
PLACES = _RANDOM.integers(0, DIMENSIONS, (BUCKETS + SHAPES, SIGNS))
VALUES = _RANDOM.choice([-1.0, 1.0], (BUCKETS + SHAPES, SIGNS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and shape of each word, and the word offsets of the texts."""
    kind = KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[SMALL[data]] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    of = kind[starts]
    bucket = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    bucket[of == 2] = 0  # all numbers are one word
    capital = np.concatenate(([0], np.cumsum(data != SMALL[data])))
    capitals = capital[ends] - capital[starts]
    begins = data[starts] != SMALL[data[starts]]
    shape = np.select(
        [of == 2, of == 3, capitals == 0, (capitals == ends - starts) & (capitals > 1), begins & (capitals == 1)],
        [0, 1, 2, 3, 4], 5,
    )
    return bucket, shape, np.searchsorted(starts, offsets)


def contexts(bucket: np.ndarray, shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors per bucket; the last column counts the words."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = [(bucket, BUCKETS + shape)]
    for step in range(1, REACH + 1):
        same = of[step:] == of[:-step]
        left, right = bucket[:-step][same], bucket[step:][same]
        pairs += [(left, right), (right, left)]
    word, near = (np.concatenate(side) for side in zip(*pairs, strict=True))
    total = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    for k in range(SIGNS):
        sums = np.bincount(word * DIMENSIONS + PLACES[near, k], VALUES[near, k], BUCKETS * DIMENSIONS)
        total[:, :DIMENSIONS] += sums.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
    total[:, DIMENSIONS] = np.bincount(bucket, minlength=BUCKETS)
    return total


def _blocks(total: np.ndarray, salt: int) -> pa.RecordBatch:
    rows = [block.tobytes() for block in np.split(total, BLOCKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(rows, pa.binary())],
        names=["block", "salt", "sums"],
    )


def context_table(docs: DataFrame) -> np.ndarray:
    """The context sums of all documents."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch["text"], PIECE_BYTES):
                total += contexts(*words(data, offsets))
                salt = (salt + len(data)) % BLOCKS
        if total[:, DIMENSIONS].any():
            yield _blocks(total, salt)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch["block"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                part = np.frombuffer(sums, np.int64)
                total[block] = total[block] + part if block in total else part
        for block, sums in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": [sums.tobytes()]})

    schema = "block int, salt int, sums binary"
    sums = docs.select("text").mapInArrow(gather, schema)
    wide = shuffle_width(docs.sparkSession)
    for keys in (("block", "salt"), ("block",)):
        sums = sums.repartition(wide, *keys).mapInArrow(add, schema)
    table = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    for row in sums.toArrow().to_pylist():
        step = BUCKETS // BLOCKS
        table[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(row["sums"], np.int64).reshape(step, -1)
    return table


def word_vectors(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector and a weight per bucket."""
    counts = table[:, DIMENSIONS].astype(np.float64)
    mean = table[:, :DIMENSIONS] / np.maximum(counts, 1)[:, None]
    share = counts / max(counts.sum(), 1)
    centre = share @ mean
    spread = np.sqrt(share @ (mean - centre) ** 2) + 1e-6
    return ((mean - centre) / spread).astype(np.float32), (RARE / (RARE + share)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The features of each text."""
    found = np.zeros((len(column), FEATURES), np.float32)
    weighted = np.concatenate([vectors * weights[:, None], vectors**2 * weights[:, None], weights[:, None]], axis=1)
    for row, _, data, offsets in text_pieces(column, PIECE_BYTES // 4):
        bucket, _, bounds = words(data, offsets)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            continue
        sums = np.add.reduceat(weighted[bucket], bounds[full], axis=0)
        mean, square = sums[:, :DIMENSIONS] / sums[:, -1:], sums[:, DIMENSIONS : 2 * DIMENSIONS] / sums[:, -1:]
        found[row + full, :DIMENSIONS] = mean
        found[row + full, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean**2, 0))
        found[row + full, -2] = np.log(np.diff(bounds)[full])
        found[row + full, -1] = 1
    return found


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features``, one row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(word_vectors(context_table(docs)))

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = pooled(batch["text"], *sent.value)
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(pool, f"doc_id {dict(docs.dtypes)['doc_id']}, features array<float>")


class Network:
    """Two layers on standardised features, and a temperature."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.state: dict = {"share": float(labels.mean()) if len(labels) else 0.5}
        if len(set(labels.tolist())) < 2:
            return
        rng = np.random.default_rng(0)
        order = rng.permutation(len(rows))
        tuning = order[: len(order) // 5] if len(order) >= 50 else order
        training = order[len(order) // 5 :] if len(order) >= 50 else order
        middle, spread = rows[training].mean(axis=0), rows[training].std(axis=0) + 1e-3
        x = (rows - middle) / spread
        weights = [
            rng.normal(size=(FEATURES, HIDDEN)) * np.sqrt(2 / FEATURES), np.zeros(HIDDEN),
            rng.normal(size=HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1),
        ]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(EPOCHS):
            for part in np.array_split(rng.permutation(training), -(-len(training) // BATCH)):
                hidden = np.maximum(x[part] @ weights[0] + weights[1], 0)
                error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - labels[part]) / len(part)
                back = error[:, None] * weights[2] * (hidden > 0)
                slopes = [x[part].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    weights[k] = weights[k] - RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.state |= {"middle": middle, "spread": spread, "weights": weights, "temperature": 1.0}
        logits = self.logits(rows[tuning])
        loss = lambda t: np.logaddexp(0, np.where(labels[tuning] == 1, -logits, logits) / t).mean()
        self.state["temperature"] = float(min(np.geomspace(0.25, 16, 97), key=loss))

    @classmethod
    def of(cls, state: dict) -> Network:
        network = cls.__new__(cls)
        network.state = state
        return network

    def logits(self, rows: np.ndarray) -> np.ndarray:
        one, two, three, four = self.state["weights"]
        hidden = np.maximum((rows - self.state["middle"]) / self.state["spread"] @ one + two, 0)
        return (hidden @ three + four) / self.state["temperature"]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if "weights" not in self.state:
            return np.full(len(rows), self.state["share"])
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -700, 700)))


def fit(rows: DataFrame, labels: DataFrame) -> Network:
    """Learns from at most about ``LABELLED`` rows, drawn by hash of the id."""
    known = (
        labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.max("quality").alias("quality"))
    )
    size = known.count()
    draw = F.pmod(F.xxhash64("of", F.lit("quality")), F.lit(1 << 40))
    drawn = known.filter(draw < int((1 << 40) * min(1.0, LABELLED / max(size, 1))))
    # Bounded by the draw, whatever the tables hold.
    both = rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("of")).select("of", "quality", "features")
    found = both.dropDuplicates(["of"]).toArrow().sort_by("of")
    if not len(found):
        return Network(np.zeros((0, FEATURES)), np.zeros(0))
    matrix = found["features"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    return Network(matrix, (found["quality"].to_numpy() > 0).astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``, one row per document."""
    rows = keep(features(docs), "quality-features")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, labels).state)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.of(sent.value)
        for batch in batches:
            matrix = batch["features"].flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(network.scores(matrix))], names=["doc_id", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
