"""N-gram Jaccard join: T-occurrence search with DivideSkip, sharded so that each search sees all it can match.

1. Equal texts (A-Z and white space folded; told apart by 128 bits of SHA-256) are one class; its smallest doc_id stands
   for it. Shingles are 64-bit hashes (the odds of a collision are in common.py).
2. Frequent shingles, found by lossy counting over all texts, come last in the order of shingles; the others are in
   hash order. Only the order and the routing depend on them, never a result, so the broadcast list may be bounded
   (MOST_FREQUENT). Their homes are known from it, so no frequent shingle is a key of a shuffle.
3. In that order, of the first n - T + s(n) shingles of two sets that link (T: the least overlap a set of n needs,
   s: least_shared) at least s of the smaller set's size are shared. A class that shares fewer has no link and is done;
   homes of too few of its shingles to miss a link are left out, those of frequent shingles first: they are the large ones.
4. Entries (shingle, class) are shuffled packed. Each shared shingle has a home, a class that holds it; classes meet in their shingles' homes, with their
   whole sets. In a home each class is a query to an inverted index of the smaller ones: short lists are merged by
   heap, long ones probed by binary search, and those that reach the overlap are kept (DivideSkip).
5. A home of more than CHUNK classes, or CHUNK_SHINGLES shingles, is dealt into chunks. Each chunk links to the home's pivot, one class; classes
   that no chunk connects with the pivot are, in blocks, queries to all chunks of the home. Classes linked to the pivot
   are already connected with each other, so no pairs of a large group are made and no link between components is lost.
   Only a home with many classes apart from its pivot costs blocks times chunks: short texts that differ in a word or
   two of one common passage without being near copies.
6. Links, of which each group gives only those that connect, go to connected components.

Nulls, ties: a null text has no words. Without words a document has n_shingles 0 and is linked with nothing. Rows that
share a doc_id are one node: they share a component. A row without doc_id links nothing; its component_id is null.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, numbered, release, settle, shingle_sets, signed, slices, table, text_digest
from .components import components

K = 5
SIMILAR = 75  # of 100
FREQUENT = 0.002  # of a batch's documents
MOST_FREQUENT = 100_000
SURE = 12  # of 100: shingles shared in the prefixes beyond the first
CHUNK = 1_000
CHUNK_SHINGLES = 1_000_000  # of a chunk's classes together
HELD = 1_500_000  # entries that a task packs at once
_PIVOT_FROM = 64


def least_overlap(n: int | np.ndarray, similar: int = SIMILAR):
    """Of a set of n with any set that it links with."""
    return -(-n * similar // 100)


def pair_overlap(a: int, b: int, similar: int = SIMILAR) -> int:
    """The smallest o with 100 * o >= similar * (a + b - o)."""
    return -(-similar * (a + b) // (100 + similar))


def least_shared(n):
    return np.maximum(1, n * SURE // 100)


def _sizes_and_frequent(k: int):
    """One pass over the texts: a row for each document with its set's size, and rows (shingle, n, a class that holds it) of each batch's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, b = shingle_sets(part.column("text"), k)
                sizes = pa.array(np.diff(b).astype(np.int64))
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.record_batch([part.column("doc_id"), part.column("h1"), part.column("h2"), sizes, none], _SIZED)
                ids = np.repeat(np.asarray(part.column("h1")), np.diff(b))
                order = np.argsort(g, kind="stable")
                keys, first, n = np.unique(g[order], return_index=True, return_counts=True)
                often = n >= max(3, FREQUENT * part.num_rows)
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.record_batch([none, pa.array(ids[order][first[often]]), none, pa.array(n[often].astype(np.int64)), pa.array(signed(keys[often]))], _SIZED)

    return run


#: A document: n is its set's size. A frequent shingle: n is its count, h1 a class that holds it.
_SIZED = ["doc_id", "h1", "h2", "n", "shingle"]


def _prefix(text: pa.Array, k: int, similar: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each row, those in `last` after all others: rows, shingles, place in last or -1."""
    g, b = shingle_sets(text, k)
    n = np.diff(b)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.full(len(g), -1)
    if len(last) and len(g):
        at = np.minimum(np.searchsorted(last, g), len(last) - 1)
        place = np.where(last[at] == g, at, -1)
        order = np.lexsort((g, place >= 0, rows))
        g, place = g[order], place[order]
    size = n - least_overlap(n, similar) + least_shared(n)
    mine = (np.arange(len(g)) - b[:-1][rows]) < size[rows]
    return rows[mine], g[mine], place[mine]


_ENTRIES = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("x", pa.binary()), ("y", pa.binary())])


def _dealt(x: np.ndarray, y: np.ndarray, by: np.ndarray, buckets: int, known: bool) -> pa.RecordBatch:
    """One row for each bucket, with its parts of x and y as bytes."""
    bucket = (by.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((x, bucket))
    x, y, bucket = x[order], y[order], bucket[order]
    names, first = np.unique(bucket, return_index=True)
    edges = np.append(first, len(x))
    cut = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())
    return pa.record_batch([pa.array(names), pa.array([known] * len(names), pa.bool_()), cut(x), cut(y)], schema=_ENTRIES)


def _pairs(rep: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (rep, home), and how many of each."""
    order = np.lexsort((home, rep))
    rep, home = rep[order], home[order]
    new = np.ones(len(rep), bool)
    new[1:] = (rep[1:] != rep[:-1]) | (home[1:] != home[:-1])
    at = np.flatnonzero(new)
    return rep[at], home[at], np.diff(np.append(at, len(rep)))


def _emit_entries(k: int, similar: int, frequent, buckets: int):
    """(shingle, class) entries, packed by bucket. Frequent shingles' homes are known already: (class, home) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_home = frequent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            x, y, _ = _pairs(*(np.concatenate(c) for c in zip(*held)))  # equal texts count once
            held.clear()
            return _dealt(x, y, x, buckets, False)

        for batch in batches:
            for part in slices(batch):
                rows, g, place = _prefix(part.column("text"), k, similar, last)
                rep = np.asarray(part.column("h1"))[rows]
                often = place >= 0
                if often.any():
                    pair = np.unique(np.stack([signed(g[often]), rep[often], last_home[place[often]]]), axis=1)
                    yield _dealt(pair[1], pair[2], pair[1], buckets, True)
                if not often.all():
                    held.append((signed(g[~often]), rep[~often]))
                if sum(len(x) for x, _ in held) >= HELD:
                    yield packed()
        if held:
            yield packed()
        release()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: (class, home, number of its shingles that others share too and that have this home, whether they are frequent)."""

    def met(x: list[bytes], y: list[bytes], known: list[bool]) -> pa.RecordBatch:
        join = lambda which: [np.frombuffer(b"".join(v for v, k in zip(c, known) if k == which), np.int64) for c in (x, y)]
        found = [(*_pairs(*join(True)), True)]
        shingle, owner = join(False)
        if len(shingle):
            order = np.lexsort((owner, shingle))
            shingle, owner = shingle[order], owner[order]
            new = np.ones(len(shingle), bool)
            new[1:] = shingle[1:] != shingle[:-1]
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(shingle)))
            least, most = owner[first], owner[first + sizes - 1]
            shared = np.repeat(least < most, sizes)
            found.append((*_pairs(owner[shared], np.repeat(least, sizes)[shared]), False))
        columns = [np.concatenate(c) for c in zip(*((*f[:3], np.full(len(f[0]), f[3])) for f in found))]
        return pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int64)), pa.array(columns[3])], ["cls", "home", "n", "often"])

    current, held = None, ([], [], [])
    for batch in batches:
        for bucket, known, x, y in zip(*(batch.column(c).to_pylist() for c in ("bucket", "known", "x", "y"))):
            if bucket != current:
                if held[0]:
                    yield met(*held)
                current, held = bucket, ([], [], [])
            for into, value in zip(held, (x, y, known)):
                into.append(value)
    if held[0]:
        yield met(*held)
    release()


def _sets(k: int):
    """A row for each cell that a class goes to, with its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, b = shingle_sets(part.column("text"), k)
                cells, at = part.column("cells").flatten(), np.diff(np.asarray(part.column("cells").offsets))
                rows = np.repeat(np.arange(part.num_rows), at)
                sets = pa.array([g[b[i] : b[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
                fields = dict(zip([f.name for f in cells.type], cells.flatten()))
                yield pa.record_batch([*(fields[n] for n in ("home", "chunk", "block", "asks", "pivot")), part.column("rep").take(pa.array(rows)), sets.take(pa.array(rows))], ["home", "chunk", "block", "asks", "pivot", "rep", "members"])

    return run


class Index:
    """Inverted lists of sets that are added in ascending size; search() is DivideSkip."""

    def __init__(self, similar: int = SIMILAR):
        self.similar, self.lists, self.sizes = similar, defaultdict(list), []

    def add(self, members: list[int]) -> None:
        for x in members:
            self.lists[x].append(len(self.sizes))
        self.sizes.append(len(members))

    def search(self, members: list[int]) -> list[int]:
        """Places of the added sets that link with this one."""
        n = len(members)
        need = least_overlap(n, self.similar)
        smallest = bisect_left(self.sizes, need)  # only sets of this size or more can have the overlap
        if smallest == len(self.sizes):
            return []
        lists = [self.lists[x] for x in members if x in self.lists]
        if len(lists) < need:
            return []
        lists.sort(key=len, reverse=True)
        long = min(need - 1, int(need / (0.01 * log2(len(lists[0]) + 1) + 1)))
        found, at, count = [], -1, 0
        counts: list[tuple[int, int]] = []
        for place in heapq.merge(*(x[bisect_left(x, smallest) :] if smallest else x for x in lists[long:])):
            if place == at:
                count += 1
            else:
                if count >= need - long:
                    counts.append((at, count))
                at, count = place, 1
        if count >= need - long:
            counts.append((at, count))
        for place, count in counts:
            goal = pair_overlap(n, self.sizes[place], self.similar)
            for left, one in zip(range(long, 0, -1), lists):
                if count >= goal or count + left < goal:
                    break
                i = bisect_left(one, place)
                count += i < len(one) and one[i] == place
            if count >= goal:
                found.append(place)
        return found


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def link_group(reps: list[int], sets: list[np.ndarray], pivot: int | None, asks: list[bool] | None, similar: int = SIMILAR) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect the group as all its links would, and the reps not connected with the pivot.

    asks: only pairs in which at least one side asks are searched. In a large group, a class that links with the
    pivot asks no further among others that do: they are connected.
    """
    n = len(reps)
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.cumsum([0] + [len(s) for s in sets])
    members = [inverse[edges[i] : edges[i + 1]] for i in range(n)]
    up = list(range(n))
    order = sorted(range(n), key=lambda i: (len(members[i]), reps[i]))
    seeks = list(asks) if asks is not None else [True] * n
    centre = reps.index(pivot) if pivot is not None else reps.index(min(reps)) if n > _PIVOT_FROM and asks is None else None
    links = []
    if centre is not None:
        mark = np.zeros(int(inverse.max()) + 1, bool)
        mark[members[centre]] = True
        for i in range(n):
            if i != centre and int(mark[members[i]].sum()) >= pair_overlap(len(members[i]), len(members[centre]), similar):
                up[_find(up, i)] = _find(up, centre)
                links.append((reps[i], reps[centre]))
                seeks[i] = False
        seeks[centre] = False
    # two indexes: of those that ask, for all others; and of all others, for those that ask
    every, asking, names, asking_names = Index(similar), Index(similar), [], []
    any_left = any(seeks)
    for i in order if any_left else ():
        mine = members[i].tolist()
        index, known = (every, names) if seeks[i] else (asking, asking_names)
        for place in index.search(mine):
            j = known[place]
            a, b = _find(up, i), _find(up, j)
            if a != b:
                up[a] = b
                links.append((reps[i], reps[j]))
        every.add(mine)
        names.append(i)
        if seeks[i]:
            asking.add(mine)
            asking_names.append(i)
    apart = [reps[i] for i in range(n) if centre is not None and _find(up, i) != _find(up, centre)]
    return links, apart


_LINKS = pa.schema([("home", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _groups(key: list[str], similar: int, rounds: str):
    """Rows sorted by key. Links as (home, a, b); in the first round also (home, rep, null) of those apart from the pivot."""

    def one(rows: list[dict]) -> pa.RecordBatch:
        home, by_rep = rows[0]["home"], {}
        for r in rows:
            if r["asks"] or (r["rep"], r["members"]) not in by_rep:
                by_rep[r["rep"], r["members"]] = r
        rows = list(by_rep.values())
        out = []
        if len(rows) > 1:
            sets = [np.frombuffer(r["members"], np.uint64) for r in rows]
            pivot = rows[0]["pivot"] if rounds == "first" else None
            links, apart = link_group([r["rep"] for r in rows], sets, pivot, [r["asks"] for r in rows] if rounds == "second" else None, similar)
            out = [(home, a, b) for a, b in links]
            if pivot is not None:
                out += [(home, rep, None) for rep in apart]
        columns = list(zip(*out)) or [()] * 3
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in key):
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)
        release()

    return run


def frequent_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """counted (shingle, n, home): the most frequent shingles of all texts, at most MOST_FREQUENT, sorted, and a class that holds each."""
    top = counted.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("home").alias("home")).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    rows = np.array([(r.shingle, r.home) for r in top.select("shingle", "home").collect()], np.int64).reshape(-1, 2)
    order = np.argsort(rows[:, 0].copy().view(np.uint64))
    return rows[order, 0].copy().view(np.uint64), rows[order, 1].copy()


def folded_digest(text: Column) -> tuple[Column, Column]:
    return text_digest(F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + "     "))


def _meetings(base: DataFrame, ids: DataFrame, counted: DataFrame, k: int, similar: int, n_parts: int) -> DataFrame:
    """h1, h2, rep, n_shingles, home: the homes in which each class that may have links meets others."""
    last = base.sparkSession.sparkContext.broadcast(frequent_shingles(counted))
    entries = base.select("h1", "text").mapInArrow(_emit_entries(k, similar, last, 4 * n_parts), "bucket int, known boolean, x binary, y binary")
    met = entries.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "cls long, home long, n long, often boolean")
    met = met.groupBy("cls", "home").agg(F.sum("n").alias("n"), F.max("often").alias("often"))
    met = met.groupBy("cls").agg(F.sum("n").alias("shared"), F.array_sort(F.collect_list(F.struct((~F.col("often")).alias("rare"), "n", "home"))).alias("homes"))
    sure = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * similar / 100) * SURE / 100))
    chosen = ids.join(met, ids.h1 == met.cls).where(F.col("shared") >= sure)
    # two that link share `sure` of either: each may leave out homes of fewer than half as many, and they still meet
    spare = F.floor((sure - 1) / 2).cast("long")
    start = F.struct(spare.alias("spare"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, x: F.when(x["n"] <= a["spare"], F.struct((a["spare"] - x["n"]).alias("spare"), a["kept"].alias("kept"))).otherwise(F.struct(a["spare"].alias("spare"), F.concat(a["kept"], F.array(x["home"])).alias("kept")))
    kept = F.aggregate("homes", start, step)["kept"]
    return settle(chosen.select("h1", "h2", "rep", "n_shingles", F.explode(kept).alias("home")), "meetings")


def _links(base: DataFrame, cells: DataFrame, key: list[str], rounds: str, k: int, similar: int, n_parts: int) -> DataFrame:
    """cells: h1, h2, rep, home, chunk, block, asks, pivot. Each cell's classes searched: home, a, b."""
    texts = base.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    of_class = cells.groupBy("h1", "h2", "rep").agg(F.collect_list(F.struct("home", "chunk", "block", "asks", "pivot")).alias("cells"))
    rows = texts.join(of_class, ["h1", "h2"]).select("rep", "cells", "text")
    rows = rows.mapInArrow(_sets(k), "home long, chunk int, block int, asks boolean, pivot long, rep long, members binary")
    return rows.repartition(n_parts, *key).sortWithinPartitions(*key, "rep").mapInArrow(_groups(key, similar, rounds), "home long, a long, b long")


def jaccard_components(docs: DataFrame, k: int = K, similar: int = SIMILAR, chunk: int | None = None, chunk_shingles: int | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, text_h1, text_h2, n_shingles, component_id for each row."""
    chunk, chunk_shingles = chunk or CHUNK, chunk_shingles or CHUNK_SHINGLES
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h1, h2 = folded_digest(F.col("text"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    seen = settle(base.mapInArrow(_sizes_and_frequent(k), "doc_id long, h1 long, h2 long, n long, shingle long"), "sized")
    sized = seen.where("shingle is null").select("doc_id", "h1", "h2", F.col("n").alias("n_shingles"))
    ids = sized.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")).where("rep is not null")
    met = _meetings(base, ids, seen.where("shingle is not null").select("shingle", "n", F.col("h1").alias("home")), k, similar, n_parts)

    parts = lambda: F.ceil(F.greatest(F.count("*") / chunk, F.sum("n_shingles") / chunk_shingles)).cast("int")
    homes = met.groupBy("home").agg(F.count("*").alias("classes"), F.min("rep").alias("pivot"), parts().alias("chunks")).where("classes > 1")
    homes = settle(homes, "homes")
    dealt = met.join(homes, "home").withColumn("chunk", F.pmod(F.xxhash64("rep", "home"), F.col("chunks")).cast("int"))
    every = F.when((F.col("chunks") > 1) & (F.col("rep") == F.col("pivot")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    pivot = F.when(F.col("chunks") > 1, F.col("pivot")).alias("pivot")
    columns = ["h1", "h2", "rep", "home", "chunk", "block", "asks", "pivot"]
    cells = dealt.withColumns({"chunk": F.explode(every), "block": F.lit(0), "asks": F.lit(True)}).select(*columns[:-1], pivot)
    first = settle(_links(base, cells, ["home", "chunk"], "first", k, similar, n_parts), "links")
    links = first.where("b is not null")

    apart = first.where("b is null").select("home", F.col("a").alias("rep")).distinct()
    if not apart.isEmpty():
        asking = dealt.select(*columns[:5], "chunks", "n_shingles").join(apart, ["home", "rep"])
        blocks = settle(asking.groupBy("home").agg(parts().alias("blocks")), "blocks")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        nobody = F.lit(None).cast("long")
        all_rows = dealt.select(*columns[:5]).join(blocks, "home").withColumns({"block": spread("blocks"), "asks": F.lit(False), "pivot": nobody})
        asking = asking.join(blocks, "home").withColumns({"chunk": spread("chunks"), "block": F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"), "asks": F.lit(True), "pivot": nobody})
        cells = all_rows.select(*columns).unionByName(asking.select(*columns))
        links = links.unionByName(_links(base, cells, ["home", "chunk", "block"], "second", k, similar, n_parts))

    found = components(links.select("a", "b"))
    named = ids.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", "rep", "component")
    rows = sized.join(named, ["h1", "h2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return rows.select(
        "doc_id", F.col("h1").alias("text_h1"), F.col("h2").alias("text_h2"), "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies, its smallest doc_id. Rows without doc_id or words stay.

    Of rows with the same doc_id and text one stays. Other columns are kept as they are, whatever their names.
    """
    groups = jaccard_components(docs).where("component_id is not null")
    firsts = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_h1", "text_h2")).alias("first")).select("first.*")
    rows = numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    h1, h2 = folded_digest(F.coalesce(text, F.lit("")))
    key = ["doc_id", "text_h1", "text_h2"]
    kept = rows.where(doc_id.isNotNull()).withColumns({"doc_id": doc_id, "text_h1": h1, "text_h2": h2}).join(firsts, key, "left_semi").dropDuplicates(key)
    return kept.select(rows.columns).unionByName(rows.where(doc_id.isNull())).toDF(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
