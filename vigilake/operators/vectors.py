"""Search by cosine in a partitioned index: cells around centroids, bounds by the triangle inequality, top k by streaming.

Vectors are brought to length one. The root of their number of them, at most CENTROIDS, the first in the order of their digests, are centroids; each
point belongs to the nearest one of its number of components, a cell's radius is its farthest point, and cells are cut into blocks of
BLOCK_BYTES. A query first visits the cell of its nearest centroid. What it finds there bounds what it still needs: a cell
whose distance less its radius is farther than the k-th best so far, or than the least likeness, cannot hold better and is
not visited. Points and queries meet by block; a block's queries are cut into slices of SLICE, so that neither a hot cell
nor a small index puts all queries in one task. A task holds one block; queries stream past it.

Only the centroids and their cells' radii pass through the driver. Points whose number of components no centroid has lie in a
cell that each such query visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settle

CENTROIDS = 256
BLOCK_BYTES = 4 << 20
SLICE = 50_000
_SPOT = ["length", "cell", "block"]


def sound(v: Column) -> Column:
    """Whether a vector has a direction: components, none null or infinite, not all zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u: each vector brought to length one; scaled first, so that no square overflows. Components are summed in one order, so equal vectors stay equal."""
    for batch in batches:
        out: list = [None] * batch.num_rows
        for _, rows, x in _by_length(batch):
            x = x / np.abs(x).max(axis=1)[:, None]
            for row, u in zip(rows, x / np.sqrt(_exact_squares(x))[:, None]):
                out[row] = u
        at = batch.schema.get_field_index("u")
        yield batch.set_column(at, "u", pa.array(out, pa.list_(pa.float64())))


def _exact_squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return out


def _units(rows: DataFrame, v: str) -> DataFrame:
    known = rows.where(sound(F.col(v))).withColumn("length", F.size(v)).withColumn("u", F.col(v).cast("array<double>")).drop(v)
    return known.mapInArrow(_scaled, known.schema)


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of the batch with vectors of one length, and these as a matrix."""
    lengths = np.asarray(batch.column("length"))
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield int(width), rows, _matrix(batch.column("u"), rows, int(width))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _assigned(shared):
    """The nearest cell of each point and the distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, 2.0)
            for width, rows, u in _by_length(batch):
                if width in shared.value:
                    numbers, centres = shared.value[width]
                    d = _distances(u, centres)
                    near = d.argmin(axis=1)
                    cell[rows], far[rows] = numbers[near], d[np.arange(len(rows)), near]
            columns = [*batch.columns, pa.array(cell), pa.array(far)]
            yield pa.record_batch(columns, [*batch.schema.names, "cell", "far"])

    return run


def _bounds(shared, radii):
    """For each query all cells of its length with the least distance that a point of theirs can have; nearest centroid first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(batch.num_rows)]
            for width, rows, u in _by_length(batch):
                if width in shared.value:
                    numbers, centres = shared.value[width]
                    radius = np.array([radii.value.get(int(c), -1.0) for c in numbers])
                    numbers, centres, radius = numbers[radius >= 0], centres[radius >= 0], radius[radius >= 0]
                    d = _distances(u, centres)
                    for i, row in enumerate(rows):
                        out[row] = [{"cell": int(numbers[j]), "low": float(max(0.0, d[i, j] - radius[j] - 1e-7))} for j in np.argsort(d[i], kind="stable")]
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64())]))
            yield pa.record_batch([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "cells"])

    return run


def _exact(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, so that equal vectors score equally."""
    out = np.zeros(len(points))
    for j in range(len(q)):
        out += q[j] * points[:, j]
    return out


def _scan(k: int, least: float):
    """Rows sorted by spot, points before queries: each query's best k of the spot's points."""
    names, kinds = ("key", "pid", "twin", "n", "negative"), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held, points = None, [], None
        for batch in batches:
            out = []
            of = list(zip(*(batch.column(c).to_pylist() for c in ("spot", "key", "pid", "twin", "n"))))
            vectors = batch.column("u")
            for i, (place, key, pid, twin, n) in enumerate(of):
                if place != spot:
                    spot, held, points = place, [], None
                v = np.asarray(vectors[i].values)
                if key is None:
                    held.append((pid, twin, n, v))
                    continue
                if points is None:
                    points = np.array([h[3] for h in held]) if held else np.zeros((0, len(v)))
                if not len(points):
                    continue
                near = points @ v
                floor = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
                at = np.flatnonzero(near >= max(floor, least) - 1e-9)
                exact = _exact(v, points[at])
                best = sorted((-s, held[j][0] is None, held[j][0] or 0, held[j][1], j) for s, j in zip(exact.tolist(), at.tolist()) if s > least)[:k]
                out += [(key, held[j][0], held[j][1], held[j][2], negative) for negative, _, _, _, j in best]
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], list(names))

    return run


def _visit(points: DataFrame, cells: DataFrame, visits: DataFrame, k: int, least: float) -> DataFrame:
    """visits (key, length, cell, u): key, pid, twin, n, negative likeness of the best k of each block that a query visits."""
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = visits.join(cells.select("length", "cell", "blocks"), ["length", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    load = asked.groupBy(*_SPOT).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    spot = F.concat_ws("/", *_SPOT, "slice")
    none = lambda kind: F.lit(None).cast(kind)
    queries = asked.join(load, _SPOT).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")))
    queries = queries.select(spot.alias("spot"), "key", none("long").alias("pid"), none("string").alias("twin"), none("long").alias("n"), "u")
    held = points.join(load, _SPOT).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    held = held.select(spot.alias("spot"), none("string").alias("key"), "pid", "twin", "n", "u")
    rows = held.unionByName(queries).repartition(partitions, "spot").sortWithinPartitions("spot", F.col("key").isNotNull())
    return rows.mapInArrow(_scan(k, least), "key string, pid long, twin string, n long, negative double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each key; cut within each partition before rows are shuffled."""
    order = [F.col("negative"), F.col("pid").asc_nulls_last(), F.col("twin")]
    return found.withColumn("_at", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_at") <= k)


def search(queries: DataFrame, points: DataFrame, k: int, least: float) -> DataFrame:
    """queries (key string, v) and points (pid long, v): key, pid, twin, n, negative: the k points of each query most similar to it, if over `least`.

    Equal points are one, with their number n; of equal likeness the smaller pid comes first, null last, then the digest `twin`.
    """
    if least < 0:
        raise ValueError("a likeness of under 0 is not searched")
    spark = queries.sparkSession
    whole = points.groupBy("pid", "v").agg(F.count("*").alias("n")).withColumn("twin", F.sha2(F.to_json(F.struct("pid", "v")), 256))
    whole = settle(_units(whole, "v").select("pid", "n", "twin", "length", "u"), "points")
    asked = _units(queries, "v").select("key", "length", "u")

    most = min(CENTROIDS, 1 + int(whole.count() ** 0.5))
    first = whole.groupBy("length").agg(F.min_by("u", "twin").alias("u"), F.min("twin").alias("twin")).orderBy("length").limit(most).collect()  # one for each length, then more
    more = whole.where(~F.col("twin").isin([r.twin for r in first])).orderBy("twin").limit(most - len(first)).collect() if len(first) < most else []
    some = [(r.length, r.u) for r in first + more]
    table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {length for length, _ in some}:
        numbers = [i for i, (length, _) in enumerate(some) if length == width]
        table[width] = np.array(numbers, np.int32), np.array([some[i][1] for i in numbers], np.float64)
    shared = spark.sparkContext.broadcast(table)

    placed = settle(whole.mapInArrow(_assigned(shared), "pid long, n long, twin string, length int, u array<double>, cell int, far double"), "placed")
    rows_of_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("length") * 8)))
    cells = placed.groupBy("length", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    cells = settle(cells.withColumn("blocks", F.ceil(F.col("rows") / rows_of_block).cast("int")), "cells")
    radii = spark.sparkContext.broadcast({r.cell: r.radius for r in cells.where("cell >= 0").select("cell", "radius").collect()})  # at most CENTROIDS
    placed = placed.join(cells.select("length", "cell", "blocks"), ["length", "cell"]).withColumn("block", F.pmod(F.xxhash64("twin"), F.col("blocks")).cast("int")).drop("blocks", "far")

    bounded = settle(asked.mapInArrow(_bounds(shared, radii), "key string, length int, u array<double>, cells array<struct<cell:int,low:double>>"), "bounded")
    elsewhere = F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0.0).alias("low")))
    visit = lambda rows, which: rows.select("key", "length", "u", F.explode(which).alias("_c")).select("key", "length", "u", "_c.cell")
    found = settle(best(_visit(placed, cells, visit(bounded, F.concat(F.slice("cells", 1, 1), elsewhere)), k, least), k).drop("_at"), "nearest")
    reached = found.groupBy("key").agg(F.when(F.count("*") >= k, -F.max("negative")).alias("kth"))
    left = bounded.join(reached, "key", "left")
    needed = F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least))
    others = F.filter(F.slice("cells", 2, CENTROIDS), lambda c: 1 - c["low"] * c["low"] / 2 >= needed)
    return best(found.unionByName(_visit(placed, cells, visit(left, others), k, least)), k).drop("_at")
