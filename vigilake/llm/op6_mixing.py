"""Mixing sources to target weights: fixed-length blocks, drawn by source, placed by pseudorandom index permutations.

1. Each source's words are laid end to end (documents in hash order) and cut into blocks of BLOCK_WORDS, or of fewer
   words where the source would have under LEAST_BLOCKS of them, down to single words; the place of a document is a prefix sum over slots, of which a hot source has many.
2. Targets: weights by source in code-point order, null last; at most MOST times a source's size.
3. A source's target gives its number of block draws, rounded up or down by chance so that many small sources together
   come near their targets too. The draws fill output shards: a shard's counts by source are a
   multinomial draw conditioned on those totals, found by halving the row of shards (seeded at each halving), so a
   shard knows its counts and its sources' running indices by itself.
4. Draw j of a source with b blocks is block permute(j mod b) of round j div b, with a permutation for each source
   and round; j < MOST * b, so no block is taken more than MOST times.
5. Draws are counted by (source, block) and joined to the documents' parts of blocks.

One row for each source is collected; more than MAX_SOURCES raises an error.

Nulls, ties: a null text has no words, a null source is a source of its own. Rows that repeat are documents of their
own: equal rows share one place order and may differ in `taken`. Documents without words get 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, settle, slices, table, word_counts

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
LEAST_BLOCKS = 8
SHARD_BLOCKS = 4096
MAX_SOURCES = 100_000
SLOTS = 1 << 14  # of each source: fixed, so that places do not depend on the session


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above most times its size; the excess is shared again by weight."""
    total = float(sum(sizes))
    capped = [s == 0 for s in sizes]
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [most * s if c else rest * w / weight for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > most * s for s, t, c in zip(sizes, out, capped)]
        if not any(over):
            return [float(t) for t in out]
        capped = [c or o for c, o in zip(capped, over)]


def _distinct(rng: np.random.Generator, n: int, k: int) -> np.ndarray:
    """k different numbers below n, any k as likely as any other."""
    out = np.unique(rng.integers(0, n, k))
    while len(out) < k:
        out = np.unique(np.concatenate([out, rng.integers(0, n, k - len(out))]))
    return out


def _thin(counts: np.ndarray, take: int, seed: int) -> np.ndarray:
    """Multivariate hypergeometric at any size: each draw is taken or not by itself, then chance ones are moved until `take` are."""
    rng = np.random.default_rng(seed)
    left = rng.binomial(counts, take / int(counts.sum()))
    over = int(left.sum()) - take
    pool = left if over > 0 else counts - left
    ends = np.cumsum(pool)
    moved = np.bincount(np.searchsorted(ends, _distinct(rng, int(ends[-1]), abs(over)), side="right"), minlength=len(counts)) if over else 0
    return left - moved if over > 0 else left + moved


def shard_counts(counts: np.ndarray, shard: int, shards: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws of each source in a shard, and in those before it. The last shard may be shorter."""
    low, high, before = 0, shards, np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = _thin(counts, min((middle - low) * per_shard, int(counts.sum())), zlib.crc32(f"{seed},{low},{high}".encode()))
        if shard < middle:
            counts, high = left, middle
        else:
            before, counts, low = before + left, counts - left, middle
    return counts, before


def permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given indices: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(zlib.crc32(key.encode())).integers(1, 1 << 63, 4, dtype=np.uint64)

    def rounds(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            m = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((m ^ (m >> np.uint64(29))) >> np.uint64(13) & mask)
        return a << np.uint64(half) | b

    out = rounds(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = rounds(out[far])
    return out.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch([*(part.column(c) for c in ("doc_id", "source", "digest")), pa.array(word_counts(part.column("text")))], ["doc_id", "source", "digest", "size"])


def _draw(sources, shards: int, per_shard: int, seed: int):
    """sources: a broadcast (blocks, quotas) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, counts = sources.value
        blocks = blocks.tolist()
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                mine, before = shard_counts(counts, shard, shards, per_shard, seed)
                source = np.repeat(np.arange(len(mine)), mine)
                index = np.empty(len(source), np.int64)
                at = 0
                for s in np.flatnonzero(mine):
                    j = before[s] + np.arange(mine[s])
                    for turn in np.unique(j // blocks[s]):
                        here = np.flatnonzero(j // blocks[s] == turn)
                        index[at + here] = permute(j[here] % blocks[s], blocks[s], f"{seed},{s},{turn}")
                    at += mine[s]
                place = np.random.default_rng(zlib.crc32(f"{seed},{shard}".encode())).permutation(len(source))
                yield pa.record_batch([pa.array(np.full(len(source), shard)), pa.array(place), pa.array(source.astype(np.int64)), pa.array(index)], ["shard", "slot", "source_index", "block"])

    return run


class Mix:
    """places: doc_id, source, row columns, size, source_size, target, step (words a block), source_index, begin (in its source's words);
    draws: shard, slot, source_index, block."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 0):
        spark = docs.sparkSession
        self.block_words = block_words
        base = docs.select("doc_id", F.col("source").cast("string"), F.xxhash64("text").alias("digest"), "text").mapInArrow(_sizes, "doc_id long, source string, digest long, size long")
        base = settle(base.withColumn("slot", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOTS)).cast("int")), "sizes")
        sums = base.groupBy("source", "slot").agg(F.sum("size").alias("words"))
        found = sums.groupBy("source").agg(F.sum("words").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] for r in found]
        aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most) if sizes else []
        steps = [min(block_words, max(1, s // LEAST_BLOCKS)) for s in sizes]
        blocks = [-(-s // n) for s, n in zip(sizes, steps)]
        chance = np.random.default_rng(zlib.crc32(f"{seed},quotas".encode())).random(len(sizes)).tolist()
        quotas = [min(most * b, math.floor(t * b / s + u)) if s else 0 for s, t, b, u in zip(sizes, aims, blocks, chance)]
        rows = [(r.source, i, s, t, n) for i, (r, s, t, n) in enumerate(zip(found, sizes, aims, steps))]
        sources = spark.createDataFrame(rows, "source string, source_index long, source_size long, target double, step long")

        before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("source", "slot", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "slot").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
        placed = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("p")
        same = F.col("p.source").eqNullSafe(F.col("b.source"))
        placed = placed.join(bases.alias("b"), same & (F.col("p.slot") == F.col("b.slot"))).select("p.doc_id", "p.digest", "p.source", "p.size", (F.col("base") + F.col("inside")).alias("begin"))
        joined = placed.alias("p").join(F.broadcast(sources.alias("s")), F.col("p.source").eqNullSafe(F.col("s.source")))
        self.places = joined.select("p.doc_id", "p.digest", "p.size", "p.begin", "s.source_index", "s.source_size", "s.target", "s.step")
        total = sum(quotas)
        shards = max(1, -(-total // SHARD_BLOCKS))
        tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        ids = spark.range(0, shards if total else 0, 1, max(1, min(shards, tasks)))
        shared = spark.sparkContext.broadcast((np.array(blocks, np.int64), np.array(quotas, np.int64)))
        self.draws = ids.mapInArrow(_draw(shared, shards, SHARD_BLOCKS, seed), "shard long, slot long, source_index long, block long")

    def parts(self) -> DataFrame:
        """Each document's part of each block, and how often the mix takes that block: ..., block, first, words, times."""
        n = F.col("step")
        own = self.places.where("size > 0")
        spans = F.sequence(F.floor(F.col("begin") / n), F.floor((F.col("begin") + F.col("size") - 1) / n))
        parts = own.withColumn("block", F.explode(spans))
        first = F.greatest(F.col("block") * n, F.col("begin"))
        last = F.least((F.col("block") + 1) * n, F.col("begin") + F.col("size"))
        parts = parts.withColumns({"first": first - F.col("begin"), "words": last - first})
        times = self.draws.groupBy("source_index", "block").agg(F.count("*").alias("times"))
        # the draws' size is unknown when the join is planned: never broadcast them
        return parts.join(times.hint("merge"), ["source_index", "block"], "left").fillna(0, ["times"])

    def taken(self) -> DataFrame:
        key = ["doc_id", "digest", "source_index", "begin", "size", "source_size", "target"]
        some = self.parts().groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        none = self.places.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none)


def _assemble(text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_name):
                texts = [_taken(text, parts) for text, parts in zip(part.column(text_name).to_pylist(), part.column("parts").to_pylist())]
                out = part.set_column(part.schema.get_field_index(text_name), text_name, pa.array(texts, pa.string()))
                yield out.select([n for n in out.schema.names if n != "parts"])

    return run


def _taken(text: str, parts: list[dict]) -> str:
    """The words of a text that its taken parts hold, in rounds."""
    words = text.encode().split()
    if all(p["times"] == 1 for p in parts) and sum(p["words"] for p in parts) == len(words):  # parts taken 0 times are not here
        return text
    parts.sort(key=lambda p: p["first"])
    rounds = range(1, max(p["times"] for p in parts) + 1)
    return b" ".join(w for r in rounds for p in parts if p["times"] >= r for w in words[p["first"] : p["first"] + p["words"]]).decode()


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each text holds its taken words, blocks taken again follow once more.

    Documents of which nothing is taken go, so those without words too. n_chars, if there is one, follows the text. Other
    columns are kept as they are, whatever their names. Of rows with the same doc_id and text each holds its own words.
    """
    mix = Mix(docs)
    order = Window.partitionBy("doc_id", "digest")
    parts = mix.parts().where("times > 0").groupBy("doc_id", "digest", "begin").agg(F.collect_list(F.struct("first", "words", "times")).alias("parts"))
    twin = mix.places.where("size > 0").select("doc_id", "digest", "begin", F.row_number().over(order.orderBy("begin")).alias("twin"))
    a, b = parts.alias("a"), twin.alias("b")
    parts = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.begin") == F.col("b.begin"))).select("a.doc_id", "a.digest", "twin", "parts")

    rows = numbered(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = rows.where(F.col(text).isNotNull()).withColumns({"doc_id": F.col(doc_id), "digest": F.xxhash64(text)})
    keyed = keyed.withColumn("twin", F.row_number().over(order.orderBy("digest"))).alias("d")
    p = parts.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.digest") == F.col("p.digest")) & (F.col("d.twin") == F.col("p.twin"))
    out = keyed.join(p, same).select(*[f"d.{c}" for c in rows.columns], "p.parts").mapInArrow(_assemble(text), rows.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
