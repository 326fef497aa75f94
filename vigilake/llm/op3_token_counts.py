"""Token counts: overlap resynchronisation of chunks of huge documents.

A text over CHUNK characters is encoded in chunks that overlap, with offsets. Two chunks are spliced at a proven
stable boundary: a white-space character inside the overlap, at least a margin from either chunk's edge, up to
which the left chunk and from which the right chunk gives the text's own tokens, and after which both give the
same tokens at the same places as far as both see. If there is none the overlap is doubled, in the end to the
whole rest. Shorter texts are encoded whole.

White space always ends a token only in vocabularies that drop it; with any other, texts are encoded whole.

Nulls, ties: a null text is empty. Every row gives one row, repeated rows and null doc_ids too. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .tokens import WORD_BPE, Encoder, encoder

CHUNK = 32_768
OVERLAP = 512
LIMIT = 2048
_SPACES = " \t\n\r\x0b\x0c"


def _splice(text: str, left: list, right: list, right_start: int, left_end: int, margin: int) -> int | None:
    """The boundary at which left's tokens go over to right's. Tokens are (id, start, end) in places of the text."""
    for p in range(right_start + margin, left_end - margin):
        if text[p] in _SPACES:
            seen_left = [t for t in left if p <= t[1] and t[2] <= left_end - margin]
            seen_right = [t for t in right if p <= t[1] and t[2] <= left_end - margin]
            crossing = any(t[1] < p < t[2] for t in left[-2 * (left_end - right_start) :]) or any(t[1] < p < t[2] for t in right[: 2 * (left_end - right_start)])
            return p if seen_left == seen_right and not crossing else None
    return None


def chunked_tokens(coder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(id, start, end) of all tokens of a text, by chunks."""

    def tokens(a: int, b: int) -> list[tuple[int, int, int]]:
        e = coder.library(text[a:b])
        return [(i, a + s, a + t) for i, (s, t) in zip(e.ids, e.offsets)]

    margin = coder.longest_special
    end = min(len(text), chunk)
    left = tokens(0, end)
    done: list[tuple[int, int, int]] = []
    while end < len(text):
        width = max(overlap, 2 * margin + 2)
        while True:
            start = max(0, end - width)
            stop = min(len(text), end + chunk)
            right = tokens(start, stop)
            tail = [t for t in left if t[2] > start]
            p = _splice(text, tail, right, start, end, margin)
            if p is not None:
                done += [t for t in left if t[2] <= p]
                left = [t for t in right if t[1] >= p]
                break
            if start == 0 or (done and start <= done[-1][2]):  # nothing before to hold on to: all that is left, at once
                p = done[-1][2] if done else 0
                left, stop = tokens(p, len(text)), len(text)
                break
            width *= 2
        end = stop
    return done + left


def _emit(vocabulary: str, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                n_bytes, n_tokens = [], []
                for text in part.column("text").to_pylist():
                    n_bytes.append(len(text.encode()))
                    if len(text) > chunk and coder.drops_space:
                        n_tokens.append(len(chunked_tokens(coder, text, chunk, overlap)))
                    else:
                        n_tokens.append(len(coder.encode(text)) >> 2)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str = WORD_BPE, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. One pass, no shuffle."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(_emit(vocabulary, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
