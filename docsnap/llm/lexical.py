"""Ranked lexical search by presence masks.

Documents are cut into terms once; what is kept of each is its number of terms and the terms asked
for with their counts. A slice of documents then meets all items. For an item the presence of its
terms becomes one bitmap per term, and the bitmaps turned over give each document the mask of terms
it holds. Documents of one mask are a group. No document of a group can score more than the sum of
the best its terms reach in the slice, so groups are scored in descending order of that sum, and
the rest is left out once the sum falls below the worst of the best ``top`` so far. What a task
has found in one slice is the bar for its next; a task writes ``top`` rows per item.

Items are sent to the tasks in blocks whose size is checked, one pass over documents per block.

Null texts have no terms. Documents and items without terms are in no result; documents without
terms do not count. Rows that repeat a document id or a whole row are documents of their own; null
ids rank behind all others of equal score. Rows that repeat an item id, null too, are one item with
the terms of all of them. Extra columns do not matter. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from docsnap.llm.common import keep, release, remembered

TOP = 10
SLICE_ROWS = 4096
PIECE_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Presence flags of one item at a time.
MASK_CELLS = 1 << 24
#: Documents that are scored before the bar is looked at again.
ROUND_DOCS = 64
NO_ID = np.iinfo(np.int64).max

#: Letters A-Z become small; other ASCII but digits and letters separates; the rest stays.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about ``PIECE_BYTES``."""
    plain, start = text.translate(PLAIN), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for terms in term_lists(text or b""):
        counts.update(terms)
    return counts


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``term``, each pair once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(_bytes(batch["text"])):
                terms = list(term_counts(text))
                if terms:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch["item_id"][row], len(terms)), pa.array(terms, pa.binary())],
                        names=["item_id", "term"],
                    )

    schema = f"item_id {dict(items.dtypes)['item_id']}, term binary"
    return items.select("item_id", "text").mapInArrow(cut, schema).distinct()


def item_blocks(terms: DataFrame, most_bytes: int) -> Iterator[DataFrame]:
    """The terms in parts of at most ``most_bytes``, or of one item each where that is larger."""
    sizes = keep(terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("size")), "search-items")
    parts = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // most_bytes))

    def part() -> Column:
        return F.pmod(F.xxhash64("item_id", F.lit(parts)), F.lit(parts))

    while not (
        sizes.groupBy(part().alias("part"))
        .agg(F.sum("size").alias("size"), F.count("*").alias("items"))
        .filter((F.col("size") > most_bytes) & (F.col("items") > 1))
        .isEmpty()
    ):
        parts *= 2
    for number in range(parts):
        yield terms.filter(part() == number)


def counted_terms(docs: DataFrame, sent) -> DataFrame:
    """``doc_id``, ``n`` (all terms) and the counts of the terms asked for, of documents with terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = remembered("terms", sent.value, lambda: {t: k for k, t in enumerate(sent.value)})
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, sizes, terms, counts = [], [], [], []
                for row, text in enumerate(_bytes(part["text"])):
                    found = term_counts(text)
                    if found:
                        known = sorted(number[t] for t in found.keys() & number.keys())
                        rows.append(row)
                        sizes.append(found.total())
                        terms.append(known)
                        counts.append([found[sent.value[k]] for k in known])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )
        release()

    schema = "doc_id long, n long, terms array<int>, counts array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, schema)


class Slice:
    """Some documents, with what each term adds to their scores before its weight."""

    def __init__(self, batch: pa.RecordBatch, documents: int, all_terms: int) -> None:
        ids = batch["doc_id"]
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.rows = batch.num_rows
        self.terms = batch["terms"].flatten().to_numpy()
        counts = batch["counts"].flatten().to_numpy()
        sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        # Products beyond 64 bits need a corpus of 10**18 over the longest document.
        m = 10 + (90 * batch["n"].to_numpy() * documents) // all_terms
        of = np.repeat(np.arange(self.rows), sizes)
        self.adds = (1_000_000_000 * counts) // (1000 * counts + 8 * m[of])
        order = np.argsort(self.terms, kind="stable")
        self.held, self.start = np.unique(self.terms[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.holders = of[order]
        self.best = np.maximum.reduceat(self.adds[order], self.start) if len(order) else self.start

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks over the terms (as flags), documents in order of mask, first of each mask."""
        step = max(1, MASK_CELLS // len(terms))
        packed = []
        for low in range(0, self.rows, step):
            high = min(low + step, self.rows)
            bitmap = np.zeros((-(-len(terms) // 64) * 64, high - low), bool)
            for bit, term in enumerate(terms):
                holders = self.holders[self.start[term] : self.end[term]]
                if step < self.rows:
                    holders = holders[np.searchsorted(holders, low) : np.searchsorted(holders, high)]
                bitmap[bit, holders - low] = True
            packed.append(np.packbits(bitmap, axis=0).T)
        masks = np.ascontiguousarray(np.concatenate(packed))
        words = masks.view(np.uint64)
        keys = words.ravel() if words.shape[1] == 1 else masks.view(f"V{masks.shape[1]}").ravel()
        _, one, of = np.unique(keys, return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(one) + 1))
        return np.unpackbits(masks[one], axis=1, count=len(terms)), order, starts

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The exact scores of documents that hold a term at least."""
        sizes = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows] - ends + sizes, sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.adds[at], ends - sizes)


class Ranking:
    """The best documents of one item so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, top: int) -> None:
        self.terms, self.weights, self.top = terms, weights, top
        self.score = self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def bar(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def take(self, part: Slice, all_weights: np.ndarray) -> None:
        at = np.searchsorted(part.held, self.terms)
        here = np.flatnonzero(at < len(part.held))
        here = here[part.held[at[here]] == self.terms[here]]
        if not len(here):
            return
        terms, weights = at[here], self.weights[here]
        flags, order, starts = part.masks(terms)
        most = flags.astype(np.int64) @ (weights * part.best[terms])
        falling = np.argsort(-most, kind="stable")
        all_weights[self.terms] = self.weights
        done = 0
        while done < len(falling) and most[falling[done]] >= self.bar():
            rows: list[np.ndarray] = []
            held = 0
            while done < len(falling) and held < ROUND_DOCS and most[falling[done]] >= self.bar():
                group = falling[done]
                rows.append(order[starts[group] : starts[group + 1]])
                held += len(rows[-1])
                done += 1
            self.add(part, np.concatenate(rows), all_weights)
        all_weights[self.terms] = 0

    def add(self, part: Slice, rows: np.ndarray, all_weights: np.ndarray) -> None:
        scores = part.scores(rows, all_weights)
        good = scores >= self.bar()
        rows = rows[good]
        score = np.concatenate([self.score, scores[good]])
        ids, null = np.concatenate([self.ids, part.ids[rows]]), np.concatenate([self.null, part.null[rows]])
        best = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.ids, self.null = score[best], ids[best], null[best]


def _best_of_tasks(counted: DataFrame, item_type: DataType, sent) -> DataFrame:
    """The best documents of each item in each task."""

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, documents, all_terms, top = sent.value
        rankings = [Ranking(*item, top) for _, *item in items]
        all_weights = np.zeros(terms, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = Slice(batch.slice(start, SLICE_ROWS), documents, all_terms)
                for ranking in rankings:
                    ranking.take(part, all_weights)
        for (item, *_), ranking in zip(items, rankings, strict=True):
            if len(ranking.score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(ranking.score), kind),
                        pa.array(ranking.ids, mask=ranking.null), pa.array(ranking.score),
                    ],
                    names=["item_id", "doc_id", "score"],
                )
        release()

    schema = f"item_id {item_type.simpleString()}, doc_id long, score long"
    kind = to_arrow_type(item_type)
    return counted.mapInArrow(rank, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the best documents of each item."""
    context = docs.sparkSession.sparkContext
    item_type = items.schema["item_id"].dataType
    asked, found, totals = keep(item_terms(items), "search-terms"), None, None
    for block in item_blocks(asked, block_bytes):
        rows = [(r[0], bytes(r[1])) for r in block.collect()]
        names = tuple(sorted({t for _, t in rows}))
        counted = keep(counted_terms(docs, context.broadcast(names)), "search-counts")
        if totals is None:
            totals = counted.agg(F.count("*"), F.sum("n")).first()
        documents, all_terms = totals
        holders = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        number = {t: k for k, t in enumerate(names)}
        weight = {
            t: floor(1000 * log((2 * documents + 2) / (2 * holders.get(k, 0) + 1))) for t, k in number.items()
        }
        of_item: dict = {}
        for item, term in rows:
            of_item.setdefault(item, []).append(term)
        made = []
        for item, terms in sorted(of_item.items(), key=str):
            terms.sort()
            made.append((item, np.array([number[t] for t in terms]), np.array([weight[t] for t in terms])))
        sent = context.broadcast((made, len(names), documents, all_terms, top))
        best = _best_of_tasks(counted, item_type, sent)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
with cut as (select row_number() over () as r, doc_id, {_TERMS} as t from documents),
docs as (select r, doc_id, t, len(t) as n from cut where len(t) > 0),
totals as (select count(*) as docs, sum(n)::bigint as terms from docs),
counts as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(t) as term from docs) group by all),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from counts, totals group by term, docs),
scores as (
  select item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join counts using (term), totals group by item_id, r, doc_id),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
  from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
