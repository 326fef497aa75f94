"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles, exact by error bounds.

Vectors are scaled by a power of two each, so that their largest component lies in [0.5, 1), and quantised to int8 with
a scale of their own. Queries and candidates are dealt into blocks, and each pair of blocks is a cell of the matrix. A cell
multiplies int8 tiles (in float32, where sums of so many products of small integers are exact), and |true - approximate|
<= |q| * |residual of c| + |residual of q| * |quantised c| bounds each distance. A query keeps the candidates whose upper bound
reaches its k-th best lower bound in the cell; these pairs are recomputed in float64 and the best k kept by heap. The cells'
lists of each query are merged by a heap of k as they stream in.

Queries are a stated set, against all rows, in blocks. A cell holds QUERY_BLOCK + CANDIDATE_BLOCK vectors, a merge k rows.

Magnitudes: any finite doubles take part. A score is the sum of products in float64; where that overflows on the way, it is
the sum over the scaled vectors, scaled back, so it is infinite only if the sum itself is out of a double's range, and never
NaN. Scores that come out equal, infinite ones and those that vanish below the least double too, are ties. Bounds allow for
both: what can reach the least infinite value is kept, and so is what the least double can hide.

Nulls, ties: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id. Rows that share a vec_id, with equal vectors or others, are rows of their own: each is a candidate, and
each that is a query has its own list (a rank then stands once for each of them). Vectors of different length are not
compared. Equal scores go to the smaller vec_id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

NEAREST = 20
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
_SLAB = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale of each row, norm of each quantised row, norm of what is lost."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near**2).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row over a power of two, so that its largest component lies in [0.5, 1), and that power."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(np.ldexp(x, -(power // 2)[:, None]), (power // 2 - power)[:, None]), power


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in float64, summed from the first component on; of scaled rows where that overflows."""
    out = _summed(a, b)
    bad = np.flatnonzero(~np.isfinite(out))
    if len(bad):
        (x, p), (y, q) = scaled(a[bad]), scaled(b[bad])
        out[bad] = _raised(_summed(x, y), p + q)
    return out


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


def _raised(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(x, power)


def cell(query_ids: np.ndarray, query_twins: np.ndarray, queries: np.ndarray, ids: np.ndarray, twins: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
    """(query, its twin, candidate, score) of each query's best k in the cell, its own row left out. twins tell rows of one id apart."""
    lowered, powers = scaled(vectors)
    cq, cs, cn, ce = quantise(lowered)
    size = cn + ce
    top = powers.max()
    weight = _raised(np.ones(len(powers)), powers - top)  # of each candidate, the largest as 1
    tile = cq.astype(np.float32)
    width = vectors.shape[1]
    for at in range(0, len(query_ids), _SLAB):
        part, part_ids, part_twins = queries[at : at + _SLAB], query_ids[at : at + _SLAB], query_twins[at : at + _SLAB]
        small, power = scaled(part)
        qq, qs, _, qe = quantise(small)
        norms = np.sqrt((small**2).sum(axis=1))
        near = (qq.astype(np.float32) @ tile.T).astype(np.float64) * qs[:, None] * (cs * weight)[None, :]
        bound = norms[:, None] * (ce * weight)[None, :] + qe[:, None] * (cn * weight)[None, :]
        hidden = _raised(np.full(len(part), 2.0 * width), -1074 - power - top)  # what rounding to the least double can hide
        bound = bound * (1 + 1e-9) + 1e-12 * norms[:, None] * (size * weight)[None, :] + 1e-300 + hidden[:, None]
        low = near - bound
        own = (part_ids[:, None] == ids[None, :]) & (part_twins[:, None] == twins[None, :])
        low[own] = -np.inf
        if len(ids) > k:
            least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(part), -np.inf)
        least = np.minimum(least, _raised(np.full(len(part), 0.999), 1024 - power - top))  # from here on scores are infinite, so ties
        rows, columns = np.nonzero((near + bound >= least[:, None]) & ~own)
        edges = np.searchsorted(rows, np.arange(len(part) + 1))
        for i in range(len(part)):
            c = columns[edges[i] : edges[i + 1]]
            scores = exact(np.broadcast_to(part[i], (len(c), width)), vectors[c])
            for negative, vec_id in heapq.nsmallest(k, zip((-scores).tolist(), ids[c].tolist())):
                yield int(part_ids[i]), int(part_twins[i]), vec_id, -negative


def _cells(k: int):
    """Rows sorted by cell; queries first."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        is_query = np.asarray(whole["is_query"])
        ids, twins = np.asarray(whole["vec_id"]), np.asarray(whole["twin"])
        width = len(whole["vector"][0])
        values = whole["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        found = list(cell(ids[is_query], twins[is_query], values[is_query], ids[~is_query], twins[~is_query], values[~is_query], k)) if is_query.any() and not is_query.all() else []
        columns = list(zip(*found)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "twin", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else [0]
            for a, b in zip(edges, edges[1:]):
                if held and cells[a] != current:
                    yield one(held)
                    held = []
                current = cells[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held)

    return run


def _merge(k: int):
    """Rows sorted by query: the best k of each, of which no more than k are held."""
    out_types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap, out = None, [], []

        def close() -> None:
            out.extend((current[0], rank, -negative_id, score) for rank, (score, negative_id) in enumerate(sorted(heap, reverse=True), 1))

        for batch in batches:
            for query, twin, c, score in zip(*(batch.column(n).to_pylist() for n in ("query_id", "twin", "vec_id", "score"))):
                if (query, twin) != current:
                    close()
                    current, heap = (query, twin), []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -c))
                else:
                    heapq.heappushpop(heap, (score, -c))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, out_types)], ["query_id", "rank", "vec_id", "score"])
            out.clear()
        close()
        columns = list(zip(*out)) or [()] * 4
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, out_types)], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """vectors (vec_id, embedding): query_id, rank, vec_id, score of the k nearest other rows of each query row."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    base = base.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    same = Window.partitionBy("vec_id", "digest").orderBy("is_query")
    base = base.withColumn("digest", F.xxhash64("vector"))
    base = settle(base.select("vec_id", "vector", "is_query", F.col("digest").bitwiseXOR(F.row_number().over(same).cast("long")).alias("twin")), "vectors")
    sizes = base.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    rows, columns = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // candidate_block))

    # the cells of the matrix: (length of vectors, block of queries, block of candidates)
    number = lambda r, c: (F.size("vector").cast("long") * rows + r) * columns + c
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = base.where("is_query").withColumn("other", spread(columns)).select(number(dealt(rows, 1), F.col("other")).alias("cell"), F.lit(True).alias("is_query"), "vec_id", "twin", "vector")
    candidates = base.withColumn("other", spread(rows)).select(number(F.col("other"), dealt(columns, 2)).alias("cell"), F.lit(False).alias("is_query"), "vec_id", "twin", "vector")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = queries.unionByName(candidates).repartition(max(n, min(rows * columns, 10_000)), "cell").sortWithinPartitions("cell")
    found = cells.mapInArrow(_cells(k), "query_id long, twin long, vec_id long, score double")
    merged = found.repartition(n, "query_id").sortWithinPartitions("query_id", "twin")
    return merged.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""
