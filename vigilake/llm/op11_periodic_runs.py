"""Periodic runs: stretches of words that repeat with a period, by a suffix automaton whose end-position sets are merged.

A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` * q long, that no word
beside it extends. The words go through a suffix automaton; its states are visited from the longest to the shortest,
and each one's set of end positions is merged into that of its suffix link, the smaller set into the larger. Two ends
that become neighbours at a state of length l share exactly l words to their left, so a distance d of at most l is the seed
of a square: the stretch of l + d words that ends at the later one has period d and cannot be extended to the left.
The seed whose next words differ is the one that ends its run; the run's other seeds are left to it, so a run is found once
and no seed is extended word by word. If the two are still neighbours when all sets of the state are merged, d is the
smallest period: a smaller one would divide d and put an end between them.

A run of L words shares L - q words with itself, so only states of at least `least` * (times - 1) / times words are merged,
and only stretches whose runs of that many words (by hash) occur again nearby can hold a run: L - q words from its start and L - q
to its end are covered by such runs of words, at most q apart. Only these stretches go to the automaton; equal words have
equal hashes, so no run is lost, and the automaton compares the words themselves.

End positions are kept in blocks of BLOCK places, so that an insertion costs the same in a set of any size.

Nulls, ties: a null or empty text has no words and no runs. A null doc_id is not made periodic by the query. Every row gives one
row, rows that repeat too. Of runs with equal exponents the first counts, then the one with the smaller period. Other
columns are ignored. A text is handled whole; the automaton takes about 250 MB for a million words that do repeat.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import Words, mixed, slices, table

LEAST, TIMES = 24, 3
BLOCK = 512


class Ends:
    """An ordered set of positions in blocks, with the neighbours of each one."""

    __slots__ = ("blocks", "keys", "size")

    def __init__(self, position: int):
        key = position // BLOCK
        self.blocks, self.keys, self.size = {key: [position]}, [key], 1

    def __iter__(self) -> Iterator[int]:
        for key in self.keys:
            yield from self.blocks[key]

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Adds a position that is not in the set; the ones before and behind it."""
        key = position // BLOCK
        block = self.blocks.get(key)
        self.size += 1
        if block is None:
            at = bisect_left(self.keys, key)
            before = self.blocks[self.keys[at - 1]][-1] if at else None
            behind = self.blocks[self.keys[at]][0] if at < len(self.keys) else None
            self.keys.insert(at, key)
            self.blocks[key] = [position]
            return before, behind
        at = bisect_left(block, position)
        before, behind = block[at - 1] if at else None, block[at] if at < len(block) else None
        if before is None or behind is None:
            place = bisect_left(self.keys, key)
            if before is None and place:
                before = self.blocks[self.keys[place - 1]][-1]
            if behind is None and place + 1 < len(self.keys):
                behind = self.blocks[self.keys[place + 1]][0]
        insort(block, position)
        return before, behind

    def next_is(self, position: int, other: int) -> bool:
        """Whether `other` comes right behind `position`; both are in the set."""
        key = position // BLOCK
        block = self.blocks[key]
        at = bisect_left(block, position) + 1
        if at < len(block):
            return block[at] == other
        return self.blocks[self.keys[bisect_left(self.keys, key) + 1]][0] == other


def runs(words: Sequence, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    machine = SuffixAutomaton()
    ends: list[int] = []  # the state of each prefix
    for word in words:
        machine.extend(word)
        ends.append(machine.last)
    shortest = -(-least * (times - 1) // times)
    length, link = machine.length, machine.link
    sets: dict[int, Ends] = {state: Ends(i) for i, state in enumerate(ends) if length[state] >= shortest}
    met: dict[int, list[tuple[int, int]]] = {}  # seeds of each state
    order = sorted((s for s in range(len(length)) if length[s] >= shortest), key=length.__getitem__, reverse=True)
    found = []
    n = len(words)
    for state in order:
        own = sets.pop(state)
        size = length[state]
        for a, b in met.pop(state, ()):
            d = b - a
            if size + d >= max(least, times * d) and (b + 1 == n or words[b + 1] != words[a + 1]) and own.next_is(a, b):
                found.append((b - size - d + 1, size + d, d))
        up = link[state]
        reach = length[up]
        if reach < shortest:
            continue
        other = sets.get(up)
        if other is None:
            sets[up] = own
            continue
        small, large = (own, other) if own.size < other.size else (other, own)
        seeds = met.setdefault(up, [])
        last = None  # of the smaller set: two of its own ends have met before, at a longer state
        for position in small:
            before, behind = large.add(position)
            if before is not None and before != last and position - before <= reach:
                seeds.append((before, position))
            last = position
            if behind is not None and behind - position <= reach:
                seeds.append((position, behind))
        sets[up] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(grams: np.ndarray, row: np.ndarray, usable: np.ndarray, k: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words that can hold runs: those that k words cover which occur again in their row, no farther than a period may be.

    grams: hash of the k words from each word on; row: whose word it is; usable: whether the k words are of one row.
    """
    at = np.flatnonzero(usable)
    if not len(at):
        return []
    key = mixed(grams[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = at[order][1:] - at[order][:-1]
    far = np.iinfo(np.int64).max
    near = np.full(len(at), far)
    near[order[1:][same]] = gap[same]
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], gap[same])
    kept = near < far
    at, near = at[kept], near[kept]
    while len(at):
        fresh = np.append(True, (at[1:] > at[:-1] + k) | (row[at[1:]] != row[at[:-1]]))
        first = np.flatnonzero(fresh)
        begins, ends = at[first], at[np.append(first[1:], len(at)) - 1] + k
        reach = (ends - begins)[np.cumsum(fresh) - 1] // times
        stays = near <= reach
        if stays.all():
            return list(zip(begins.tolist(), ends.tolist()))
        at, near = at[stays], near[stays]
    return []


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def no_change(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words as they are."""


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten: which word stands at each place, so that from some place on words repeat three times and more."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(texts: pa.Array, ids: list, change: Callable, least: int, times: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and the runs of each row."""
    w = Words(texts)
    counts = np.diff(w.bounds)
    places = np.arange(len(w.hash))
    changed = {}
    for i, (doc_id, n) in enumerate(zip(ids, counts.tolist())):
        moved = change(doc_id, n)
        if moved is not None:
            changed[i] = moved
            places[w.bounds[i] : w.bounds[i + 1]] = w.bounds[i] + moved
    k = max(1, -(-least * (times - 1) // times))
    w.hash = w.hash[places]
    row = np.repeat(np.arange(len(counts)), counts)
    usable = np.arange(len(row)) + k <= w.bounds[1:][row]
    of_row: dict[int, list[tuple[int, int]]] = {}
    for begin, end in stretches(w.grams(k), row, usable, k, times):
        of_row.setdefault(int(row[begin]), []).append((begin, end))
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").encode().split()
        if i in changed:
            words = [words[j] for j in changed[i].tolist()]
        at = int(w.bounds[i])
        yield words, [(a - at + s, n, q) for a, b in of_row.get(i, ()) for s, n, q in runs(words[a - at : b - at], least, times)]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable[[int | None, int], np.ndarray | None] = no_change) -> DataFrame:
    """docs (doc_id, text): doc_id, runs (start, length, period of each, by start, then period), collapsed text. No shuffle.

    change(doc_id, number of words) may give the places of the words that are read in their stead; None reads them as they are.
    """
    if least < 2 or times < 2:
        raise ValueError("a run repeats at least twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, left = [], []
                for words, of_text in _found(part.column("text"), part.column("doc_id").to_pylist(), change, least, times):
                    found.append([dict(zip(("start", "length", "period"), r)) for r in of_text])
                    left.append(b" ".join(collapsed(words, of_text)).decode())
                yield pa.record_batch([part.column("doc_id"), pa.array(found, _RUNS), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """Of runs by start, then period: the one with the greatest exponent, the first of equal ones. Null if there are none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), change=made_periodic).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    told = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
