"""Language identification with a presence kernel, landmarks and ridge regression.

Texts are lower-cased and everything but letters becomes single spaces. The kernel of two texts is
the number of distinct 1-, 2- and 3-grams that they share, divided by the root of the product of
their own numbers: a blended spectrum of presence. Landmark texts span the feature space
(Nyström); one ridge regression per language, against all others, is solved in it. Scoring is two
matrix products per piece: presence of the landmarks' grams in it by landmarks, and kernels by weights.

The model is fitted on a bounded sample of the labelled rows, ``SAMPLE`` texts spread alike over at
most as many languages, drawn by hash of the id; every gram of a whole text counts. Grams are of
code points, so letters of all scripts are told apart.

A text that is null or has no letter gets ``und`` and score 0, and so does every text where nothing
could be learned. Rows with null id are scored, never learned from. Repeated rows are scored
alike. Extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import keep, parts, remembered, text_pieces

UNKNOWN = "und"
SAMPLE, LANDMARKS = 1_200, 128
RIDGE, FLOOR = 1e-3, 1e-6
#: Every code point is a symbol of its own.
ALPHABET = 0x110000
PIECE_BYTES = 1 << 18
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; those without id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def letters() -> np.ndarray:
    """Of each code point its small letter, or a space if it is no letter."""
    return remembered("letters", 0, _letters)


def _letters() -> np.ndarray:
    table = np.full(0x110000, 32, np.int32)
    for code in range(0x30000):
        character = chr(code)
        if character.isalpha():
            table[code] = ord(character.lower()[0])
    return table


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters and single spaces of the texts end to end, and the offsets in them."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    places = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = letters()[codes]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    keep[places[places < len(codes)]] = codes[places[places < len(codes)]] != 32
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[places]


def exact_grams(text: np.ndarray) -> np.ndarray:
    """The distinct grams of one folded text in order, up to three code points to a number."""
    width = ALPHABET + 2
    one = text.astype(np.int64)
    two = one[:-1] + width * (one[1:] + 1)
    found = np.concatenate([one, two, two[:-1] + width * (width + 1) * (one[2:] + 1)])
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


class Model:
    """What is learned: columns, landmarks as bits, and weights; small enough to send along."""

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model whose attributes these are; plain values need no import where they arrive."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def __init__(self, languages: list[str], grams: list[np.ndarray]) -> None:
        """``grams`` are the distinct grams of the sample texts, languages[i] that of text i."""
        self.names = sorted(set(languages))
        chosen = self._landmarks(languages)
        self.columns = np.unique(np.concatenate([grams[i] for i in chosen]))
        present = np.zeros((len(self.columns), len(chosen)), bool)
        for k, i in enumerate(chosen):
            present[np.searchsorted(self.columns, grams[i]), k] = True
        self.landmarks = np.packbits(present, axis=1)
        self.sizes = np.array([len(grams[i]) for i in chosen], np.float32)
        kernel = np.concatenate([self.kernels(grams[k : k + 50]) for k in range(0, len(grams), 50)]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[chosen])
        keep = values > FLOOR * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel @ root
        target = np.where(np.array(languages)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        gram = features.T @ features + RIDGE * len(grams) * np.eye(features.shape[1])
        self.weights = (root @ np.linalg.solve(gram, features.T @ target)).astype(np.float32)

    def _landmarks(self, languages: list[str]) -> list[int]:
        """As many texts of each language as there is room for, in the order of the sample."""
        each = max(1, LANDMARKS // len(self.names))
        of = {name: [i for i, x in enumerate(languages) if x == name][:each] for name in self.names}
        return sorted(i for rows in of.values() for i in rows)

    @staticmethod
    def symbols() -> np.ndarray:
        return np.arange(ALPHABET)

    def kernel(self, presence: np.ndarray, own: np.ndarray, columns=slice(None)) -> np.ndarray:
        """Kernels with the landmarks; ``presence`` is of those columns, ``own`` the numbers of grams."""
        bits = np.unpackbits(self.landmarks[columns], axis=1, count=len(self.sizes)).astype(np.float32)
        return (presence @ bits) / np.sqrt(self.sizes) / np.sqrt(np.maximum(own, 1))[:, None]

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """The same for sets of grams, over no more columns than occur in them."""
        places = []
        for found in sets:
            at = np.minimum(np.searchsorted(self.columns, found), len(self.columns) - 1)
            places.append(at[self.columns[at] == found])
        used = np.unique(np.concatenate(places))
        presence = np.zeros((len(sets), len(used)), np.float32)
        for row, at in enumerate(places):
            presence[row, np.searchsorted(used, at)] = 1
        return self.kernel(presence, np.array([len(s) for s in sets], np.float32), used)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, data, offsets in text_pieces(column, PIECE_BYTES):
            text, bounds = folded(data, offsets)
            sets = [exact_grams(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            values = self.kernels(sets) @ self.weights
            best = values.argmax(axis=1)
            letter = np.diff(np.concatenate(([0], np.cumsum(text != 32)))[bounds]) > 0
            names += [self.names[b] if x else UNKNOWN for b, x in zip(best.tolist(), letter.tolist(), strict=True)]
            top = (values[np.arange(len(best)), best].astype(np.float64) + 1) / 2
            scores.append(np.where(letter, np.clip(top, 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def sample_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``draw`` and the grams of about ``SAMPLE`` labelled texts, alike by language.

    Counting reads two narrow columns; texts are read of the rows drawn only, and leave the
    executors as distinct grams.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # One text each at least: of more languages than the sample has texts the most frequent count.
    counts = keep(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE), "languages")
    languages = counts.count()
    each = -(-SAMPLE // max(1, languages))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    # A little more than asked for, so that the surplus can be cut by the order of the draw.
    share = counts.select(F.col("lang").alias("of"), (F.lit(1.25 * each * (1 << 30)) / F.col("count")).alias("below"))
    drawn = known.withColumn("draw", draw).join(F.broadcast(share), F.col("lang") == F.col("of")).filter("draw < below")

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_pieces(batch["text"], PIECE_BYTES):
                text, bounds = folded(data, offsets)
                sets = [exact_grams(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["lang"].slice(row, end - row), batch["draw"].slice(row, end - row),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["lang", "draw", "grams"],
                )

    return drawn.select("lang", "draw", "text").mapInArrow(grams, "lang string, draw long, grams binary")


def fit(docs: DataFrame) -> Model | None:
    rows = sample_grams(docs).toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")]).to_pylist()
    each, taken, languages, grams = -(-SAMPLE // max(1, len({r["lang"] for r in rows}))), {}, [], []
    for row in rows:
        found = np.frombuffer(row["grams"], np.int64)
        if taken.get(row["lang"], 0) < each and (found != 32).any():
            taken[row["lang"]] = taken.get(row["lang"], 0) + 1
            languages.append(row["lang"])
            grams.append(found)
    return Model(languages, grams) if grams else None


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` as a struct ``doc``, with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value and Model.of(sent.value)
        for batch in parts(batches):
            if known is None:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                names, scores = known.predict(batch["doc"].field("text"))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(names, pa.string()), pa.array(scores)], names=["doc", "lang_pred", "score"]
            )

    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc {kind}, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score``, one row per document."""
    found = languages(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def identified_documents(docs: DataFrame, least_score: float) -> DataFrame:
    """The documents whose language is told with at least that score; columns as they were."""
    found = languages(docs, fit(docs))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("doc.*")
