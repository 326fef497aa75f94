"""Substring deduplication: suffix automata of reference shards, matching statistics of everything that can match.

1. Equal texts (told apart by 128 bits of SHA-256) are one class; its first document (smallest doc_id, null last) stands for it.
2. Winnowing gives each window of 20 words an anchor, the smallest hash of its 6-word runs, so equal windows
   have equal anchors. Only anchors that occur twice in the corpus matter (pre-aggregated count).
3. Each repeated anchor has a home, the smallest block of 512 words that holds it. Runs of windows go to their
   anchors' homes: a home is a reference shard of bounded size, and holds every occurrence of its windows.
4. A shard's suffix automaton grows in document order; each run is streamed through it before its new windows
   are added. Matching statistics of 20 or more are the repeated spans. Words are compared, not hashes.
5. Anchors with more than HOT occurrences would make a shard unbounded. Their windows are grouped by their own
   128-bit digest instead, with pre-aggregation: exact, and no group is ever collected.

Broadcasting the automata of the whole reference would grow with the corpus; shards and what can match them
are brought together by key instead. `broadcast_spans` broadcasts one automaton of a reference of checked size.

Nulls, ties: a null text has no words. A null doc_id comes after all others. Rows with the same doc_id and text
are one document; rows that share only the doc_id are ordered by a digest of the text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .automaton import SuffixAutomaton, matching_statistics, repeated_spans
from .common import Words, mixed, quoted, release, settle, signed, slices, table, text_digest

WINDOW = 20
GRAM = 6
BLOCK = 512
HOT = 256


def _anchors(text: pa.Array, window: int):
    """Hash of the run at each word, each window's anchor (0 where no window starts), Words."""
    w = Words(text)
    n = len(w.hash)
    gram = min(GRAM, window)
    span = window - gram + 1
    g = w.grams(gram)
    ends = np.repeat(w.bounds[1:], np.diff(w.bounds))
    least = g.copy()
    width = 1
    while width < span:
        move = min(width, span - width)
        if move < n:
            least[: n - move] = np.minimum(least[: n - move], least[move:])
        width += move
    starts = np.arange(n) + window <= ends
    return g, np.where(starts, least, np.uint64(0)), starts, span, w


def _picked(g: np.ndarray, anchor: np.ndarray, span: int) -> np.ndarray:
    """Words at which some window's anchor stands."""
    most, width = anchor.copy(), 1
    while width < span:
        move = min(width, span - width)
        if move < len(most):
            most[move:] = np.maximum(most[move:], most[:-move].copy())
        width += move
    return np.flatnonzero((g == most) & (most > 0))


def _rows_of(bounds: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, words, side="right") - 1


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, anchor, _, span, w = _anchors(part.column("text"), window)
                at = _picked(g, anchor, span)
                rows = _rows_of(w.bounds, at)
                cls = np.asarray(part.column("h1"))[rows].view(np.uint64)
                block = ((at - w.bounds[rows]) // BLOCK).astype(np.uint64)
                home = mixed(cls + block * np.uint64(0x9E3779B97F4A7C15))
                yield pa.record_batch([pa.array(signed(g[at])), pa.array(signed(home))], ["anchor", "home"])

    return run


def _emit_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, anchor, starts, _, w = _anchors(part.column("text"), window)
                n = len(anchor)
                if not n:
                    continue
                new = starts.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | ~starts[:-1]
                within = np.arange(n) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
                new |= starts & (within % (1 << 20) == 0)
                begin = np.flatnonzero(new)
                stop = np.flatnonzero(starts & ~np.append(starts[1:] & ~new[1:], False)) + 1
                rows = _rows_of(w.bounds, begin)
                h1, h2 = (np.asarray(part.column(c))[rows] for c in ("h1", "h2"))
                spot = ((begin - w.bounds[rows]) << 24) | (stop - begin)
                yield pa.record_batch([pa.array(signed(anchor[begin])), pa.array(h1), pa.array(h2), pa.array(spot)], ["anchor", "h1", "h2", "spot"])

    return run


_PIECES = pa.schema([("home", pa.int64()), ("first_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])


def _windows(words: list[bytes], start: int, count: int, window: int):
    """128-bit digests of the windows that start at start..start+count."""
    for s in range(start, min(start + count, len(words) - window + 1)):
        d = hashlib.blake2b(b" ".join(words[s : s + window]), digest_size=16).digest()
        yield s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _emit_pieces(window: int):
    """Texts of the runs for each home; for hot anchors, their windows' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for row in part.to_pylist():
                    words = row["text"].encode().split()
                    key = row["first_id"], row["h1"], row["h2"]
                    held: list = []  # home, start, end of windows
                    for r in sorted(row["runs"], key=lambda r: r["spot"]):
                        start, count = r["spot"] >> 24, r["spot"] & ((1 << 24) - 1)
                        if r["hot"]:
                            out += [(None, *key, s, None, a, b) for s, a, b in _windows(words, start, count, window)]
                        elif held and held[-1][0] == r["home"] and held[-1][2] == start:
                            held[-1][2] += count
                        else:
                            held.append([r["home"], start, start + count])
                    out += [(home, *key, s, b" ".join(words[s : e + window - 1]), None, None) for home, s, e in held]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)], schema=_PIECES)

    return run


def _stream_shards(window: int):
    """Rows sorted by home, then document order: one automaton for each home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple] = []
            for h, h1, h2, start, text in zip(*(batch.column(c).to_pylist() for c in ("home", "h1", "h2", "start", "words"))):
                if h != home:
                    home, automaton = h, SuffixAutomaton()
                out += [(h1, h2, start + a, start + b) for a, b in repeated_spans(automaton, text.split(b" "), window)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "begin", "stop"])
        release()

    return run


def _cut(window: int, names: list[str]):
    """Documents with the spans of their class; later copies of a text lose every window, and so every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
                for text, spans, first in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "is_first"))):
                    words = text.encode().split()
                    kept, at = [], 0
                    if not first and len(words) >= window:
                        at = len(words)
                    else:
                        for s in sorted((x["begin"], x["stop"]) for x in spans or ()):
                            if s[0] > at:
                                kept += words[at : s[0]]
                            at = max(at, s[1])
                    kept += words[at:]
                    joined = b" ".join(kept)
                    out["kept_text"].append(joined.decode() if len(kept) < len(words) else text)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                types = {"n_words": pa.int64(), "n_removed": pa.int64()}
                yield pa.record_batch([pa.array(out[c], types.get(c, pa.string())) if c in out else part.column(c) for c in names], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text): one row per row of docs with doc_id, n_words, n_removed, kept_sha256, kept_text.

    kept_text is the text itself where nothing is removed, else the kept words joined by one space. carry names
    columns of docs that the result has too, as the struct `carried`.
    """
    h1, h2 = text_digest(F.col("text"))
    more = [F.struct(*map(quoted, carry)).alias("carried")] if carry else []
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    base = base.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), *(["carried"] if carry else []))
    classes = base.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text"))

    seen = classes.mapInArrow(_emit_anchors(window), "anchor long, home long")
    repeated = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("home").alias("home")).where("n >= 2")
    runs = classes.mapInArrow(_emit_runs(window), "anchor long, h1 long, h2 long, spot long")
    found = runs.join(repeated.select("anchor", "home", (F.col("n") > HOT).alias("hot")), "anchor")
    by_class = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("spot", "home", "hot")).alias("runs"))
    pieces = settle(  # both sides are partitioned by the class already: no text moves again
        classes.join(by_class.hint("merge"), ["h1", "h2"]).select("h1", "h2", "first_id", "text", "runs")
        .mapInArrow(_emit_pieces(window), "home long, first_id long, h1 long, h2 long, start long, words binary, w1 long, w2 long"),
        "repeats",
    )

    order = [F.col("first_id").asc_nulls_last(), "h1", "h2", "start"]
    shards = pieces.where("home is not null").select("home", "first_id", "h1", "h2", "start", "words")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = shards.repartition(n, "home").sortWithinPartitions("home", *order).mapInArrow(_stream_shards(window), "h1 long, h2 long, begin long, stop long")

    place = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "h1", "h2", "start")
    windows = pieces.where("home is null").select("w1", "w2", place.alias("place"))
    firsts = windows.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = settle(firsts, "windows")  # a plain join, of which Spark can split a hot window
    hot = windows.join(firsts, ["w1", "w2"]).where("place > first").select("place.h1", "place.h2", F.col("place.start").alias("begin"), (F.col("place.start") + window).alias("stop"))

    spans = cold.unionByName(hot).groupBy("h1", "h2").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    firsts = base.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    judged = settle(firsts.join(spans.hint("merge"), ["h1", "h2"], "left"), "judged")  # a plain join follows, of which Spark can split a hot text
    rows = base.join(judged.hint("merge"), ["h1", "h2"])
    rows = rows.select("doc_id", "text", "h1", "h2", "spans", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("is_first"), *(["carried"] if carry else []))
    rows = rows.withColumnsRenamed({"h1": "text_h1", "h2": "text_h2"})
    ours = [rows.schema[c] for c in ("doc_id", "text_h1", "text_h2")]
    made = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), *([StructField("kept_text", StringType())] if with_text else [])]
    schema = StructType([*ours, *made, *([rows.schema["carried"]] if carry else [])])
    return rows.mapInArrow(_cut(window, schema.names), schema)


def broadcast_spans(spark: SparkSession, docs: DataFrame, reference: list[str], window: int = WINDOW, max_words: int = 500_000) -> DataFrame:
    """Spans of docs that stand in a reference of at most max_words words, by one broadcast automaton."""
    total = sum(len(x.encode().split()) for x in reference)
    if total > max_words:
        raise ValueError(f"the reference has {total} words; at most {max_words} are broadcast: use remove_repeats over both")
    shared = spark.sparkContext.broadcast([x.encode().split() for x in reference])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for words in shared.value:
            automaton.new_strand()
            for word in words:
                automaton.extend(word)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                known = matching_statistics(automaton, (text or "").encode().split())
                marks = sorted({p for i, n in enumerate(known) if n >= window for p in range(i - window + 1, i + 1)})
                for _, group in itertools.groupby(enumerate(marks), lambda x: x[1] - x[0]):
                    span = [p for _, p in group]
                    out.append((doc_id, span[0], span[-1] + 1))
            columns = list(zip(*out)) or [()] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "stop"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, stop long")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) as s from w where len(ws) >= 20),
k as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as win from p),
r as (select doc_id, s, row_number() over (partition by win order by doc_id, s) as rk from k),
c as (select distinct doc_id, unnest(generate_series(s, s + 19)) as pos from r where rk > 1),
x as (select doc_id, list(pos) as gone from c group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(ws, lambda v, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
from w left join x on w.doc_id = x.doc_id
"""
