"""Packing by power-of-two decomposition: documents are cut into pieces of binary length, equal lengths are bucketed.

A document of n ids (its text's, then the end id) gives n // 2048 pieces of 2048 and one for each binary digit of
the rest. Each piece is a sequence of its own, so no sequence crosses documents and none is padded: lengths are
powers of two. Sequences of one length have consecutive ids (a bucket), in an order that reruns repeat.

Numbering takes no global sort: counts for (length, slot) are added up, and rows are numbered inside a slot. There are
SLOTS of each length whatever the session, so the numbers are the same in any.

Nulls, ties: a null text is empty and gives the end id alone. Rows that repeat, or share a doc_id or have none, are
packed each for itself. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, slices, table, wide_hash
from .tokens import WORD_BPE, encoder

LONGEST = 2048
END_ID = 1
SLOTS = 4_096


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, largest first, that add up to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _emit(vocabulary: str, longest: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    data = coder.encode(text) + end
                    n, at = len(data) >> 2, 0
                    for length in binary_lengths(n, longest):
                        piece = data[at * 4 : (at + length) * 4]
                        rows.append(row)
                        starts.append(at)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        if with_ids:
                            ids.append(piece)
                        at += length
                take = pa.array(rows, pa.int64())
                out = {"doc_id": part.column("doc_id").take(take), "h1": part.column("h1").take(take)}
                out |= {k: pa.array(v, pa.int64()) for k, v in (("start", starts), ("length", lengths), ("ids_crc32", crcs), ("doc_tokens", totals))}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (bytes) for each piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    h1, _ = wide_hash(F.col("text"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", h1.alias("h1"))
    schema = "doc_id long, h1 long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    pieces = base.mapInArrow(_emit(vocabulary, longest, end_id, with_ids), schema)
    pieces = settle(pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "h1", "start"), F.lit(SLOTS)).cast("int")), "pieces")

    counts = pieces.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length and slot: 12 x SLOTS
    bases = counts.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slot").orderBy("doc_id", "h1", "start", "ids_crc32")
    numbered = pieces.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(bases), ["length", "slot"])
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
