"""Elements of one array of large JSON documents, read by many tasks.

Spark's text reader cuts a file into byte ranges and, told that lines end at `}`, into segments. Whether a segment begins inside a
string, and how deep, depends on all before it; what it does to both is known from itself: unescaped quotes flip the one, brackets
outside strings move the other. A first pass adds that up for each range, under both assumptions; prefix sums over the ranges,
one row each, give every range its start. The second pass cuts the ranges into elements where a `}` comes back to the array's
depth. Only the pieces at the ends of ranges are brought together; no other text is shuffled, and the files may lie in any store
that Spark reads.

Which array an element belongs to is the key in front of the first element of each array; later ones inherit it. A name is looked
for at the array's depth only, whatever the keys above it. Elements that are no objects are passed over. A document that is cut off gives
the elements that are whole. Files must be UTF-8 and not compressed, or one task reads each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.S)
_NEXT = re.compile(r"\s*,\s*\{")
_SPOT = ["file", "at"]


def structure(segment: str) -> tuple[int, int, int]:
    """Of a segment and the } behind it: quotes modulo 2, and the change of depth if it begins outside and inside a string."""
    parts = _ESCAPED.sub("", segment).split('"')
    quotes = (len(parts) - 1) & 1
    even, odd = "".join(parts[::2]), "".join(parts[1::2])
    moved = lambda s: s.count("{") + s.count("[") - s.count("]")
    return quotes, moved(even) - (quotes == 0), moved(odd) - (quotes == 1)


def first_of_array(text: str, depth: int, inside: int, array_depth: int) -> tuple[str | None, str | None]:
    """The key of the array that the element at the end of a text begins, and the element itself; None, None if it is no object of an array.

    depth, inside: those where the text begins. The element is what lies behind the last bracket that left the array's depth. The
    key is empty if an object stands there in the array's place, None if what encloses the element begins before the text.
    """
    key = name = start = None
    i, quoted = 0, None
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = 0
                name = text[quoted + 1 : i] if quoted is not None else None
        elif c == '"':
            inside, quoted = 1, i
        elif c in "{[":
            if depth == array_depth and c == "{":
                start = i
            depth += 1
            if depth == array_depth:
                key, start = name if c == "[" else "", None
        elif c in "}]":
            if depth == array_depth:
                key = None
            depth -= 1
        elif c not in " \t\r\n:":
            name = None
        i += 1
    return (key, text[start:]) if start is not None else (None, None)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Consecutive segments of one byte range: what stands in the columns, and a piece of its segments."""
    for batch in batches:
        heads = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        segments = batch.column("value").to_pylist()
        a = 0
        for b in range(1, len(heads) + 1):
            if b == len(heads) or heads[b] != heads[a]:
                yield heads[a], segments[a:b]
                a = b


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at, quotes modulo 2 and changes of depth of each range, from either start."""
    spot, state = None, None

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x]) for x in (*spot, state[0], state[2], state[3])], ["file", "at", "quotes", "outside", "inside"])

    for here, segments in _runs(batches, _SPOT):
        if here != spot:
            if spot:
                yield told()
            spot, state = here, [0, 1, 0, 0]
        for s in segments:
            quotes, outside, inside = structure(s)
            for i in (0, 1):
                state[2 + i] += inside if state[i] else outside
                state[i] ^= quotes
    if spot:
        yield told()


def _cut(array_depth: int):
    """Elements and, at the ends of ranges, pieces of them: file, at, n (0 is the range's first), whether it ends here, key of its array if told, depth and string state where the text begins, text."""
    names = ["file", "at", "n", "ended", "key", "depth", "inside", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held, n, out, size = None, [], 0, [], 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def rest() -> None:
            if spot and held:
                out.append((*spot, n, False, None, begun[0], begun[1], "".join(held)))

        for (file, at, inside0, depth0), segments in _runs(batches, [*_SPOT, "start_inside", "start_depth"]):
            if (file, at) != spot:
                rest()
                spot, held, n, current = (file, at), [], 0, None
                inside, depth = inside0, depth0
                begun = (depth, inside)
            for s in segments:
                quotes, outside_by, inside_by = structure(s)
                depth += inside_by if inside else outside_by
                inside ^= quotes
                held.append(s + "}")
                if not inside and depth == array_depth:
                    text = "".join(held)
                    if n and not _NEXT.match(text):
                        key, text = first_of_array(text, *begun, array_depth)
                        current = current if key is None else key
                    elif n:
                        text = text[text.index("{") :]
                    out.append((*spot, n, True, current, begun[0], begun[1], text))
                    size += len(text or "")
                    held, n, begun = [], n + 1, (depth, 0)
                if size > 4 << 20:
                    yield rows()
                    size = 0
            if out:
                yield rows()
                size = 0
        rest()
        yield rows()

    return run


def _joined(array_depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, depth, inside in zip(*(batch.column(c).to_pylist() for c in ("text", "depth", "inside"))):
                plain = _NEXT.match(text) and depth == array_depth and not inside
                out.append((None, text[text.index("{") :]) if plain else first_of_array(text, depth, inside, array_depth))
            columns = list(zip(*out)) or [()] * 2
            yield pa.record_batch([batch.column("file"), batch.column("at"), *(pa.array(c, pa.string()) for c in columns)], ["file", "at", "key", "text"])

    return run


def json_elements(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The objects of the array under keys (one after the other from the document's root): file, seq, text.

    seq orders the elements of all files, by file name and place, and is unique; numbers may be left out.
    """
    array_depth = len(keys) + 1
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    sums = raw.mapInArrow(_summed, "file string, at long, quotes long, outside long, inside long")
    sums = sums.groupBy(*_SPOT).agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])  # one row each already
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start_inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    starts = starts.withColumn("start_depth", F.coalesce(F.sum(F.when(F.col("start_inside") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    # one row for each byte range (128 MB of input): broadcast, so that the text stays where and in the order it is read
    placed = raw.join(F.broadcast(starts.select(*_SPOT, "start_inside", "start_depth")), _SPOT)
    pieces = placed.select("value", *_SPOT, "start_inside", "start_depth").mapInArrow(_cut(array_depth), "file string, at long, n long, ended boolean, key string, depth long, inside int, text string")

    ends = pieces.where("n = 0 or not ended")
    order = Window.partitionBy("file").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("element", F.coalesce(F.sum(F.col("ended").cast("long")).over(order), F.lit(0)))
    part = F.array_sort(F.collect_list(F.struct("at", "n", "text", "ended", "depth", "inside")))
    whole = numbered.groupBy("file", "element").agg(part.alias("p")).where(F.element_at("p", -1)["ended"])
    whole = whole.select("file", F.element_at("p", -1)["at"].alias("at"), F.col("p")[0]["depth"].alias("depth"), F.col("p")[0]["inside"].alias("inside"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    firsts = whole.mapInArrow(_joined(array_depth), "file string, at long, key string, text string").withColumn("n", F.lit(0).cast("long"))

    inner = pieces.where("n > 0 and ended").select("file", "at", "n", "key", "text")
    # the key that holds for a range's first element and on, until the range itself tells another
    told = firsts.select("file", "at", F.lit(0).alias("turn"), "key").unionByName(inner.where("key is not null").groupBy("file", "at").agg(F.max_by("key", "n").alias("key")).withColumn("turn", F.lit(1)).select("file", "at", "turn", "key"))
    upto = Window.partitionBy("file").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    after = told.withColumn("held", F.last("key", True).over(upto)).where("turn = 0").select("file", F.col("at"), "held")
    every = firsts.select("file", "at", "n", "text", F.lit(None).cast("string").alias("key")).unionByName(inner).where("text is not null")
    mine = every.join(F.broadcast(after), _SPOT, "left").where(F.coalesce("key", "held") == keys[-1])  # one row for each byte range
    counts = pieces.groupBy(*_SPOT).agg(F.max("n").alias("most"))
    bases = counts.withColumn("base", F.coalesce(F.sum(F.col("most") + 1).over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*_SPOT, "base")  # one row for each byte range
    return mine.join(F.broadcast(bases), _SPOT).select("file", (F.col("base") + F.col("n")).alias("seq"), "text")
