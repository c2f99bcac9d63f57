"""Similarity join on word n-grams by Bayesian pruning of MinHash candidates.

Documents with equal shingle sets are one node. Nodes that agree in a band of their MinHash
values meet in a bucket; with 32 bands of four values a pair at the threshold of 0.8 shares none
with probability below 1e-7. Within a bucket the values of a pair are compared a few at a
time, and the pair is dropped once the posterior probability of reaching the threshold, given the
matches so far and a uniform prior, is below ``tolerance``. What is left is verified exactly on
the shingle sets.

A pair counts in its first common band only, so no pair is counted twice and none is written
out: tasks give sums of links per node and a spanning forest. Buckets of the same members are
compared once. A bucket above the block size is cut into blocks, and each pair of blocks is a
group of its own, so no bucket has to fit in one task. Sets are built again from the texts of nodes in
shared buckets only; until then a node is a few numbers.

Null texts and texts without words link with nothing. A text of fewer than five words is one
shingle of all its words. Rows without id have no class and no links of their own, but count as
links of others. Rows of one id with different texts share a class. Repeated rows are links of
each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import keep, mix, parts, runs, shuffle_width, text_pieces
from docsnap.llm.graph import components
from docsnap.llm.words import PLACE, shingle_sets

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS = 32, 4
STEP = 16
PIECE_BYTES = 1 << 19
BLOCK_NODES, BLOCK_SHINGLES = 2_000, 1_500_000
_RANDOM = np.random.Generator(np.random.PCG64(8))
FACTORS = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(narrow), 4096):
        np.minimum(low, (FACTORS * narrow[None, k : k + 4096] + SHIFTS).min(axis=1), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, different for equal values in different bands."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((parts * PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACE[ROWS])


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    one = mix(shingles ^ PLACE[40]).sum(dtype=np.uint64)
    two = mix(shingles ^ PLACE[41]).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the matches below which a pair is dropped.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its mass
    above t is the chance of at most m successes of n + 1 at t.
    """
    least = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, the key of its shingle set, its size, and its band keys."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for row, end, data, offsets in text_pieces(batch["text"], PIECE_BYTES):
                sets = shingle_sets(data, offsets, width)
                keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
                bands = band_keys(np.stack([signature(s) for s in sets])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, end - row),
                        pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(
                            np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel()
                        ),
                    ],
                    names=["doc_id", "k1", "k2", "n", "bands"],
                )

    schema = "doc_id long, k1 long, k2 long, n int, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, schema)


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for _, _, data, offsets in text_pieces(batch["text"], PIECE_BYTES):
                sets = shingle_sets(data, offsets, width)
                keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["k1", "k2", "shingles"],
                )

    return docs.select("text").mapInArrow(build, "k1 long, k2 long, shingles binary")


class Bucket:
    """The nodes of one bucket, or of two of its blocks, and the links found between them."""

    def __init__(self, rows: pa.Table) -> None:
        self.copies = rows["copies"].to_numpy()
        self.band = rows["band_no"][0].as_py()
        self.left, self.right = (
            np.flatnonzero(rows[x].to_numpy(zero_copy_only=False)) for x in ("is_left", "is_right")
        )
        self.inner = rows["inner"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        self.sizes = np.array([len(s) for s in sets])
        self.signatures = np.stack([signature(s) for s in sets])
        self.keys = band_keys(self.signatures)
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.flags = np.zeros(len(names), bool)
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.links = np.zeros(len(sets), np.int64)
        self.parent = np.arange(len(sets))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def compare(self, threshold: float, least: list[int]) -> None:
        ratio = Fraction(threshold).limit_denominator(10_000)
        for i in self.left.tolist():
            others = self.right[self.right > i] if self.inner else self.right
            small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
            others = others[small * ratio.denominator >= large * ratio.numerator]
            matches = np.zeros(len(others), np.int64)
            for step, most in enumerate(least):
                part = slice(step * STEP, (step + 1) * STEP)
                matches += (self.signatures[others, part] == self.signatures[i, part]).sum(axis=1)
                stay = matches >= most
                others, matches = others[stay], matches[stay]
            if len(others):
                shared = self.keys[others] == self.keys[i]
                others = others[shared.argmax(axis=1) == self.band]
            if len(others):
                self.verify(i, others, ratio)

    def verify(self, i: int, others: np.ndarray, ratio: Fraction) -> None:
        self.flags[self.codes[i]] = True
        for part in np.array_split(others, -(-len(others) // 256)):
            codes = np.concatenate([self.codes[k] for k in part])
            starts = np.concatenate(([0], np.cumsum(self.sizes[part])[:-1]))
            common = np.add.reduceat(self.flags[codes].astype(np.int64), starts)
            union = self.sizes[part] + self.sizes[i] - common
            linked = part[common * ratio.denominator >= union * ratio.numerator]
            self.links[i] += self.copies[linked].sum()
            self.links[linked] += self.copies[i]
            for k in linked.tolist():
                a, b = self.root(i), self.root(k)
                self.parent[max(a, b)] = min(a, b)
        self.flags[self.codes[i]] = False


def links_of(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per node and group, its links there and the node it hangs on."""
    least = least_matches(threshold, tolerance)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "grp"):
            bucket = Bucket(rows)
            bucket.compare(threshold, least)
            linked = np.flatnonzero(bucket.links)
            if len(linked):
                roots = np.array([bucket.root(k) for k in linked.tolist()])
                nodes = rows["node"].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[linked]), pa.array(bucket.links[linked]), pa.array(nodes[roots])],
                    names=["node", "links", "root"],
                )

    columns = ["grp", "band_no", "inner", "is_left", "is_right", "node", "copies", "shingles"]
    return buckets.select(*columns).mapInArrow(compare, "node long, links long, root long")


def ngram_links(
    docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``doc_id``, ``class_id`` and ``n_links``, one row per row of ``docs``.

    The class is the smallest id reachable over links; links are other rows of at least the
    threshold, whether copies or not.
    """
    spark = docs.sparkSession
    rows = keep(sketches(docs, width), "join-sketches")
    nodes = keep(
        rows.filter("n > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "join-nodes",
    )
    copies = rows.filter("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    banded = nodes.select("node", "k1", "k2", "n", F.posexplode("bands").alias("band_no", "band"))
    shared = (
        banded.groupBy("band", "band_no")
        .agg(
            F.count("*").alias("members"), F.sum("n").alias("shingles"),
            F.bit_xor(F.xxhash64("k1", "k2")).alias("who"),
        )
        .filter("members > 1")
    )
    # Of buckets with the same members the one of the first band stands for all.
    chosen = keep(
        shared.groupBy("members", "shingles", "who")
        .agg(F.min_by("band", "band_no").alias("band"), F.min("band_no").alias("band_no"))
        .withColumn(
            "blocks",
            F.greatest(
                F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
            ).cast("int"),
        )
        .select("band", "band_no", "blocks"),
        "join-buckets",
    )
    members = keep(
        banded.join(chosen, ["band", "band_no"]).select("band", "band_no", "blocks", "node", "k1", "k2"),
        "join-members",
    )
    needed = keep(members.select(F.col("node").alias("doc_id")).distinct(), "join-needed")
    sets = _sets_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(needed, "doc_id", "left_semi"), width)
    full = sets.join(members.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
        F.first("shingles").alias("shingles")
    )
    full = keep(full.join(copies, ["k1", "k2"]), "join-sets")
    block = F.pmod(F.xxhash64("k2"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, "block").alias("x"), F.greatest(k, "block").alias("y")),
    )
    dealt = (
        members.withColumn("block", block.cast("int"))
        .withColumn("pair", F.explode(pairs))
        .select(
            F.xxhash64("band", "band_no", "pair.x", "pair.y").alias("grp"),
            "band_no", "node", "k1", "k2",
            F.expr("pair.x = pair.y").alias("inner"),
            F.expr("block = pair.x").alias("is_left"),
            F.expr("block = pair.y").alias("is_right"),
        )
        .join(full, ["k1", "k2"])
        .repartition(shuffle_width(spark), "grp")
        .sortWithinPartitions("grp", "node")
    )
    found = keep(links_of(dealt, threshold, tolerance), "join-links")
    near = found.groupBy("node").agg(F.sum("links").alias("near"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (
        nodes.select("k1", "k2", "node")
        .join(copies, ["k1", "k2"])
        .join(near, "node", "left")
        .join(groups, "node", "left")
        .filter("copies > 1 or near is not null or component is not null")
        .select("k1", "k2", "node", "copies", "near", "component")
    )
    known = keep(known, "join-classes")
    linked = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("near", F.lit(0))
    return (
        rows.select("doc_id", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2")
        .join(known, ["k1", "k2"], "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), linked).alias("n_links"),
        )
    )


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The documents but for those whose class has a smaller id; columns as they were.

    Rows without id stay. Of rows that repeat an id as a whole, one per text stays.
    """
    gone = keep(
        ngram_links(docs, **options).filter("class_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(),
        "join-gone",
    )
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("doc.*")


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else
    list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 10 * count(*) >= 8 * (a.n + b.n - count(*))),
reach(node, other) as (
  select a, b from pairs union select r.node, p.b from reach r join pairs p on p.a = r.other)
select d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) as class_id, coalesce(l.n, 0) as n_links
from documents d
left join (select node, min(other) as low from reach group by node) c on c.node = d.doc_id
left join (select a, count(*) as n from pairs group by a) l on l.a = d.doc_id
"""
