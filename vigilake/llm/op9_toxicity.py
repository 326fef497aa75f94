"""Toxicity: a linear classifier trained by non-negative positive-unlabelled learning, in numpy.

Training rows are documents whose crc32(doc_id) mod 5 is not 0. Positives are those marked toxic; everything else is
unlabelled text, whether or not a label says 0. The class prior is the toxic share of the labelled training rows.
The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss; where the second
term falls below zero its gradient is turned back, as in non-negative PU learning.

Features: presence of words (A-Z lower-cased, ends stripped of punctuation) and of their first 4 and 5 bytes. All
that the positives of the sample hold significantly more often than text at large are used; how often text at large
holds them is counted over every training document. A feature must stand in LEAST_POSITIVES documents of the sample, so
the sample bounds their number. labels, lang, source and doc_id are never features.

Confirmed positives are a sample, the first most_positive in hash order of doc_id (a parameter of train()); unlabelled rows
are all there are. What a row is to the risk is the set of features it has, so rows are grouped by that set and counted: the
risk is a sum over these groups. They are dealt into shards of about SHARD entries, a group of many rows into equal shares, so
each shard is the whole in small. A shard's models, all that are compared side by side, are fitted full batch to its unlabelled
rows and all sampled positives, and the shards' weights are averaged by their rows; one shard is the plain fit. A task holds one
shard; sums of weights are added up by SUMMERS tasks before they come to the driver.
Whether prefixes are used and how strongly weights decay is chosen among SETTINGS by the non-negative risk itself on a third
of the groups' documents that a fit left out, so from positives and unlabelled text alone; rows held out are never looked
at. Every document is scored over its whole text.

Nulls, ties: a null text is empty and gets the score of no features. A null doc_id is held out. A document with
several labels is positive if any says 1. Every row gives one row, rows that repeat too. Without positives (or an empty
table) all scores are the prior, 0 if there are no labels. Other columns are ignored; keep_clean() keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _FOLD, numbered, settle, slices, table

MOST_POSITIVE = 4_000
SHARD = 1_000_000
SUMMERS = 32
LEAST_POSITIVES = 5
LEAST_TELLING = 5.0
#: Decay of words and of prefixes (None: no prefixes), of which cross-validation chooses. Prefixes serve inflected and compound words.
SETTINGS = ((5e-4, 1e-2), (5e-4, None), (5e-3, 5e-2))
PREFIXES = (4, 5)
FOLDS = 5
PARTS = 3  # of the cross-validation
EPOCHS, RATE = 250, 0.1
_LOWER = bytes(_FOLD)
_EDGES = b".,;:!?\"'()[]{}<>-_*"


def _words(text: str) -> set[bytes]:
    """Distinct words, A-Z lower-cased, without punctuation at their ends."""
    return {w.strip(_EDGES) for w in set(text.encode().translate(_LOWER).split())}


def features(text: str) -> set[bytes]:
    """Each word, and its first bytes where it is longer."""
    words = _words(text)
    return {b"=" + w for w in words}.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))


class Finder:
    """Which of some features a text has, by meeting sets of them with sets of the text's."""

    def __init__(self, names: list[bytes]):
        self.words = {x[1:]: i for i, x in enumerate(names) if x[:1] == b"="}
        self.prefixes = {n: {x[1:]: i for i, x in enumerate(names) if x[:1] == b"^" and len(x) == n + 1} for n in PREFIXES}
        self.prefixes = {n: p for n, p in self.prefixes.items() if p}

    def __call__(self, text: str) -> list[int]:
        words = _words(text)
        found = [self.words[w] for w in words & self.words.keys()]
        for n, known in self.prefixes.items():
            found += [known[p] for p in {w[:n] for w in words if len(w) > n} & known.keys()]
        return sorted(found)


@dataclass
class Model:
    names: list[bytes]
    weights: np.ndarray
    bias: float

    def scorer(self):
        find, weights = Finder(self.names), self.weights.tolist()

        def score(text: str | None) -> float:
            z = self.bias + sum(weights[i] for i in find(text or ""))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score

    def score(self, text: str | None) -> float:
        return self.scorer()(text)


class Chunk:
    """Groups of rows of one kind that have the same features: which, the part that they are left out with, how many rows each."""

    def __init__(self, at: list[np.ndarray], positive: bool, part: np.ndarray, n: np.ndarray):
        self.positive, self.part, self.n = positive, part[:, None], n[:, None].astype(float)
        self.flat = np.concatenate(at).astype(np.int64)
        sizes = np.array([len(x) for x in at])
        self.some = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]
        order = np.argsort(self.flat, kind="stable")  # by feature, for the gradient
        self.owner = np.repeat(np.arange(len(at)), sizes)[order]
        self.features, self.feature_starts = np.unique(self.flat[order], return_index=True)

    def margins(self, w: np.ndarray) -> np.ndarray:
        """w: features and the bias, for each model a column."""
        out = np.zeros((len(self.part), w.shape[1]))
        if len(self.some):
            for i, column in enumerate(np.ascontiguousarray(w.T)):  # one at a time: several times faster than rows of them
                out[self.some, i] = np.add.reduceat(column[self.flat], self.starts)
        return out + w[-1]

    def add_by_feature(self, value: np.ndarray, out: np.ndarray) -> None:
        """Adds the groups' values to their features' rows, and all of them to the bias's."""
        out[-1] += value.sum(axis=0)
        if len(self.features):
            for i, column in enumerate(np.ascontiguousarray(value.T)):
                out[self.features, i] += np.add.reduceat(column[self.owner], self.feature_starts)


_ENTRIES = 200_000  # of a chunk


def chunks(positive: np.ndarray, part: np.ndarray, at: list[bytes], n: np.ndarray) -> list[Chunk]:
    out = []
    for kind in (True, False):
        rows = np.flatnonzero(positive == kind)
        size = np.cumsum([len(at[i]) // 4 + 1 for i in rows])
        for share in np.split(rows, np.searchsorted(size, np.arange(_ENTRIES, size[-1], _ENTRIES))) if len(rows) else []:
            if len(share):
                out.append(Chunk([np.frombuffer(at[i], np.int32) for i in share], kind, part[share], n[share]))
    return out


class Models:
    """Linear models that are fitted side by side by the non-negative risk; model m leaves the rows of part left[m] out (-1: none)."""

    def __init__(self, n_features: int, prior: float, decay: np.ndarray, used: np.ndarray, left: np.ndarray):
        """decay, used: of each feature (rows) and model (columns)."""
        self.n_features, self.prior, self.left = n_features, prior, left
        self.decay, self.used = np.vstack([decay, np.zeros(len(left))]), np.vstack([used, np.ones(len(left), bool)])
        self.weights = np.zeros((n_features + 1, len(left)))
        self.weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))

    def sums(self, groups: list[Chunk], weights: np.ndarray | None = None) -> np.ndarray:
        """What a pass adds up, one vector: for each model inside (0) and outside (1) its fit the numbers and losses of both kinds, and the gradients' sums."""
        w = self.weights if weights is None else weights
        totals, gradients = np.zeros((2, 5, len(self.left))), np.zeros((3, self.n_features + 1, len(self.left)))
        for c in groups:
            margin = c.margins(w)
            inside = c.part != self.left
            away = np.logaddexp(0, margin)
            values = ((0, 1.0), (2, away - margin), (3, away)) if c.positive else ((1, 1.0), (4, away))
            for at, here in ((0, inside), (1, ~inside)):
                for row, value in values:
                    totals[at, row] += (c.n * value * here).sum(axis=0)
            s = c.n * inside / (1 + np.exp(-np.clip(margin, -30, 30)))
            c.add_by_feature(s, gradients[1 if c.positive else 2])
            if c.positive:
                c.add_by_feature(c.n * inside, gradients[0])
        return np.concatenate([totals.ravel(), gradients.ravel()])

    def _split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.left)
        return sums[: 10 * m].reshape(2, 5, m), sums[10 * m :].reshape(3, self.n_features + 1, m)

    def risk(self, sums: np.ndarray, outside: bool = False) -> np.ndarray:
        """Of each model, over the rows of its fit or those left out of it: prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])."""
        toward, away = self.parts(sums, outside)
        return toward + np.maximum(0, away)

    def parts(self, sums: np.ndarray, outside: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The two parts of the risk; the second may be negative."""
        n_p, n_u, toward, away_p, away_u = self._split(sums)[0][int(outside)]
        n_p, n_u = np.maximum(n_p, 1), np.maximum(n_u, 1)
        return self.prior * toward / n_p, away_u / n_u - self.prior * away_p / n_p

    def gradient(self, sums: np.ndarray) -> np.ndarray:
        """Of the risk where its second part is not negative; else the first part's, less the second's (turned back)."""
        totals, (held, p, u) = self._split(sums)
        n_p, n_u = np.maximum(totals[0][0], 1), np.maximum(totals[0][1], 1)
        toward, away = self.prior * (p - held) / n_p, u / n_u - self.prior * p / n_p
        return np.where(self.parts(sums)[1] >= 0, toward + away, toward - away)

    def fit(self, sums_of: Callable[[np.ndarray], np.ndarray], epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adam; sums_of gives the sums of a whole pass for some weights."""
        moment, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, epochs + 1):
            grad = np.where(self.used, self.gradient(sums_of(self.weights)) + self.decay * self.weights, 0.0)
            moment = 0.9 * moment + 0.1 * grad
            square = 0.999 * square + 0.001 * grad**2
            self.weights = self.weights - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)


def compared(names: list[bytes], prior: float) -> Models:
    """For each of SETTINGS a model that leaves out each part, then one that leaves out none."""
    prefix = np.array([x[:1] == b"^" for x in names], bool)
    each = [(np.where(prefix, b or 0.0, a), np.ones(len(names), bool) if b is not None else ~prefix) for a, b in SETTINGS for _ in range(PARTS + 1)]
    return Models(len(names), prior, np.stack([d for d, _ in each], axis=1), np.stack([u for _, u in each], axis=1), np.array([*range(PARTS), -1] * len(SETTINGS)))


def choose(models: Models, sums: np.ndarray) -> int:
    """The place in SETTINGS with the least risk on the rows left out, the first of equal ones; the first too if a part lacks positives."""
    outside = models._split(sums)[0][1]
    cross = models.left >= 0
    if outside[0][cross].min() < 4:
        return 0
    return int(np.argmin(np.where(cross, models.risk(sums, True), 0.0).reshape(-1, PARTS + 1).sum(axis=1)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _of_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            n = Counter(x for text in part.column("text").to_pylist() for x in features(text))
            yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])


def _counted(names):
    """How many texts hold each feature; one row of sums for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = Finder(names.value), np.zeros(len(names.value), np.int64)
        for batch in batches:
            for part in slices(batch):
                found = [i for text in part.column("text").to_pylist() for i in find(text)]
                n += np.bincount(np.array(found, np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["at", "n"])

    return run


def _indexed(names):
    """The features of each row, as bytes of 32-bit numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(names.value)
        for batch in batches:
            for part in slices(batch):
                at = [np.array(find(t), np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(at, pa.binary())], ["doc_id", "at"])

    return run


def _added(vectors: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    total = None
    for v in vectors:
        v = np.frombuffer(v, np.float64)
        total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _total(rows: DataFrame, run) -> np.ndarray:
    """What run's vectors of all tasks add up to, by way of SUMMERS tasks."""
    whole = lambda batches: _added(v for b in batches for v in b.column("sums").to_pylist())
    parts = rows.mapInArrow(run, "sums binary").repartition(SUMMERS).mapInArrow(whole, "sums binary").collect()
    return np.sum([np.frombuffer(v, np.float64) for v in sorted(bytes(r.sums) for r in parts)], axis=0)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    return np.array(batch.column("positive").to_pylist(), bool), np.array(batch.column("part"), np.int64), batch.column("at").to_pylist(), np.array(batch.column("n"), np.int64)


def dealt(groups: DataFrame, shards: int) -> DataFrame:
    """The unlabelled groups with the shard of each share: the rows of a group go to all shards in equal numbers, what is over to some."""
    unlabelled = groups.where("not positive").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(shards)) - 1)))
    share = F.expr(f"n div {shards}") + (F.col("_j") < F.col("n") % shards).cast("long")
    return unlabelled.select("positive", "part", "at", share.alias("n"), F.pmod(F.xxhash64("at", "part") + F.col("_j"), F.lit(shards)).alias("shard"))


def fit_all(groups: DataFrame, models: Models, shard: int = SHARD) -> np.ndarray:
    """groups (positive, part, at, n): fits the models, and gives the sums of a last pass over all groups."""
    context = groups.sparkSession.sparkContext
    size = groups.agg(F.coalesce(F.sum(F.length("at") / 4 + 1), F.lit(0)).alias("n")).first().n
    shards = max(1, int(-(-size // shard)))
    held = groups.where("positive").orderBy("part", "at").collect()  # at most most_positive groups
    positives = context.broadcast((np.array([r.part for r in held], np.int64), [bytes(r["at"]) for r in held], np.array([r.n for r in held], np.int64)))

    def one(batches: list[pa.RecordBatch]) -> bytes:
        _, part, at, n = (np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x, []) for x in zip(*map(_columns, batches)))
        more_part, more_at, more_n = positives.value
        kind = np.repeat([False, True], [len(at), len(more_at)])
        order = sorted(range(len(at)), key=lambda i: (part[i], at[i]))  # the same sums in any order of rows
        rows = chunks(kind, np.append(part[order], more_part), [at[i] for i in order] + more_at, np.append(n[order], more_n))
        mine = Models(models.n_features, models.prior, models.decay[:-1], models.used[:-1], models.left)
        mine.fit(lambda w: mine.sums(rows, w), EPOCHS, RATE)
        return np.append(mine.weights.ravel() * n.sum(), float(n.sum())).tobytes()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors() -> Iterator[bytes]:
            held, current = [], None
            for batch in batches:
                shard = np.asarray(batch.column("shard"))
                edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
                for a, b in zip(edges, edges[1:]):
                    if held and shard[a] != current:
                        yield one(held)
                        held = []
                    current = shard[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield one(held)

        yield from _added(vectors())

    total = _total(dealt(groups, shards).repartition(max(1, min(shards, 10_000)), "shard").sortWithinPartitions("shard"), fitted)
    if np.ndim(total):
        models.weights = total[:-1].reshape(models.weights.shape) / total[-1]
    weights = context.broadcast(models.weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(models.sums(chunks(*_columns(b)), weights.value).tobytes() for b in batches)

    return _total(groups, summed)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, shard: int = SHARD) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). most_positive bounds the positives that features and weights are fitted to."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().join(known, "doc_id", "left")
    ids = settle(ids.select("doc_id", "toxic", (F.coalesce("toxic", F.lit(0)) == 1).alias("positive"), F.xxhash64("doc_id").alias("turn")), "labelled")
    tally = ids.agg(F.count("toxic").alias("n"), F.count_if("positive").alias("p")).first()
    prior = tally.p / tally.n if tally.n else 0.0
    bias = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    if not tally.p:
        return Model([], np.zeros(0), bias)
    sample = settle(ids.where("positive").orderBy("turn", "doc_id").limit(most_positive).select("doc_id"), "positives")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = settle(whole.join(F.broadcast(sample), "doc_id").select("text"), "training")  # most_positive numbers

    n_positive = texts.count()
    often = texts.mapInArrow(_of_positives, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = sorted((bytes(r.feature), r.n) for r in often.where(F.col("n") >= LEAST_POSITIVES).collect())
    candidates = spark.sparkContext.broadcast([x for x, _ in found])
    every = whole.where(~held_out(F.col("doc_id")))
    counts = every.select("text").mapInArrow(_counted(candidates), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n_at_large = np.zeros(len(found))
    for r in counts:
        n_at_large[r["at"]] = r.n
    p = np.array([n for _, n in found], float)
    expected = n_positive * (n_at_large + 1) / (every.count() + 1)
    telling = (p - expected) / np.sqrt(expected + 1)
    names = [x for (x, _), t in zip(found, telling) if t >= LEAST_TELLING]
    if not names:
        return Model([], np.zeros(0), bias)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = every.mapInArrow(_indexed(spark.sparkContext.broadcast(names)), f"doc_id {kind}, at binary")  # features only: no text is shuffled
    roles = ids.join(F.broadcast(sample.withColumn("sampled", F.lit(True))), "doc_id", "left").where("sampled or not positive")
    rows = rows.join(roles.select("doc_id", "positive", F.pmod("turn", F.lit(PARTS)).cast("int").alias("part")), "doc_id")
    groups = settle(rows.groupBy("positive", "part", "at").agg(F.count("*").alias("n")), "groups")
    models = compared(names, prior)
    chosen = choose(models, fit_all(groups, models, shard))
    w = models.weights[:, chosen * (PARTS + 1) + PARTS]
    return Model([x for x, v in zip(names, w[:-1]) if v], w[:-1][w[:-1] != 0], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, score, predicted. One pass, no shuffle; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array([of(t) for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without those that the model rejects. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = numbered(docs), f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array([of(t) < 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
