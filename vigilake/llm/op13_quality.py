"""Quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, of digits or of other signs of a text, as it is written (`of%%%` is `of` and `%%%`). Each word
and each pair of neighbours is hashed to one of BUCKETS places; a word of letters that equals the one before it or the one
before that has a place more, the same for all of them, as a pair of equal words that were never seen says as much. So weights are a vector of fixed size and a text is a
sparse vector: how often each place is met, over the root of the number of its n-grams. score is the logistic of its
product with the weights.

Training (FTRL-proximal, one row at a time, EPOCHS times in hash order of doc_id) keeps for each place the sum z of its
gradients, shifted by the weights' moves, and the sum n of their squares; a weight is 0 while |z| <= L1 and otherwise
-(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2), so that rare places stay 0. It takes labelled documents whose
crc32(doc_id) mod 4 is not 2, at most most_labelled of them (parameter of train()), the first in hash order. That and
BUCKETS bound what the driver and the broadcast hold. labels, lang, source and doc_id are never features.
Every document is scored over its whole text.

Nulls, ties: a null text is empty and scores the bias alone, as does one without words. A null doc_id is held out. A
document with several labels counts as 1 if any says 1; null labels are none. Every row gives one row, rows that repeat too.
Without labels (or with an empty table) every score is 0.5. Other columns are ignored; keep_good() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _IS_SPACE, _PRIMES, _offsets, _polynomials, mixed, numbered, slices, table

BUCKETS = 1 << 18
MOST_LABELLED = 8_000
FOLDS, HELD_OUT = 4, 2
GOOD = 0.7
EPOCHS = 10
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letters and all beyond ASCII, 2 digits, 3 signs
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[_IS_SPACE] = 0
_AGAIN = int(mixed(np.array([_BASE], np.uint64))[0] % np.uint64(BUCKETS))  # the place that all repeated words share


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and pairs of each row: (places, bounds)."""
    offsets = _offsets(text)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.int64), np.zeros(len(text) + 1, np.int64)
    offsets = offsets - first
    data = np.frombuffer(text.buffers()[2], np.uint8)[first:last]
    kind = _CLASS[data]
    fresh = np.ones(len(data) + 1, bool)  # another class than the byte before, or another row
    fresh[1:-1] = kind[1:] != kind[:-1]
    fresh[offsets] = True
    edges = np.flatnonzero(fresh)
    solid = kind[edges[:-1]] > 0
    begins, ends = edges[:-1][solid], edges[1:][solid]
    high, low = (_polynomials(data, begins, ends, p) for p in _PRIMES)
    word = mixed(mixed(high << np.uint64(32) | low) + (ends - begins).astype(np.uint64))
    bounds = np.searchsorted(begins, offsets)
    # after each word the pair that it ends (but for a row's first word), then the sign that it says a word again
    n = np.diff(bounds)
    place = np.arange(len(word)) - np.repeat(bounds[:-1], n)
    letters = kind[begins] == 1
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (word[back:] == word[:-back]) & (place[back:] >= back) & letters[back:]
    width = 1 + (place > 0) + again
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.int64)
    out[at] = (word % np.uint64(BUCKETS)).astype(np.int64)
    second = np.flatnonzero(place > 0)
    out[at[second] + 1] = (mixed(word[second - 1] * np.uint64(_BASE) + word[second]) % np.uint64(BUCKETS)).astype(np.int64)
    out[at[again] + 2] = _AGAIN
    return out, np.append(at, len(out))[bounds]


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each place
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        """Of each row the logistic of its sparse product with the weights."""
        places, bounds = grams(text)
        n = np.diff(bounds)
        total, some = np.zeros(len(n)), n > 0
        if some.any():
            total[some] = np.add.reduceat(self.weights[places].astype(np.float64), bounds[:-1][some])
        z = self.bias + total / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Leader:
    """FTRL-proximal over sparse rows; the last place is the bias, which no penalty holds."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == len(self.z) - 1
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> float:
        """One row, its places distinct; the chance of label 1 before the update."""
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = float(1 / (1 + np.exp(-np.clip(w @ value, -30, 30))))
        g = (p - label) * value
        square = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += square
        return p

    def model(self) -> Model:
        w = self.weights(np.arange(len(self.z)))
        return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """rows: places, values and label of each."""
    leader = Leader(BUCKETS)
    for _ in range(epochs):
        for at, value, label in rows:
            leader.update(at, value, label)
    return leader.model()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct places and their values as bytes: never more than BUCKETS of them, whatever its length."""
    for batch in batches:
        for part in slices(batch):
            places, bounds = grams(part.column("text"))
            at, values = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                distinct, often = np.unique(places[a:b], return_counts=True)
                at.append(distinct.astype(np.int32).tobytes())
                values.append((often / np.sqrt(max(b - a, 1))).astype(np.float32).tobytes())
            yield pa.record_batch([part.column("turn"), part.column("doc_id"), part.column("label"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["turn", "doc_id", "label", "at", "value"])


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """docs (doc_id, text), labels (doc_id, quality). Fitted to at most most_labelled rows that are not held out."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where("quality is not null")
    ids = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().join(known, "doc_id")
    sample = ids.select("doc_id", (F.col("quality") == 1).cast("int").alias("label"), F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(most_labelled)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # most_labelled rows of three numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("turn", "doc_id", "label", "text").mapInArrow(_vectors, f"turn long, doc_id {kind}, label int, at binary, value binary").collect()
    found.sort(key=lambda r: (r.turn, r.doc_id, bytes(r["at"]), bytes(r["value"])))  # the same model in any order of partitions
    return fit([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64), r.label) for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, score, predicted. One pass, no shuffle; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(shared.value.scores(part.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = GOOD) -> DataFrame:
    """docs, all columns, whose score is at least `least`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = numbered(docs), f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(shared.value.scores(part.column(text)) >= least))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
