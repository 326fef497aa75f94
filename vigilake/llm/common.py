"""Shared pieces of the corpus operators: tables, the shared folder, and vectorised word hashing.

Words are split at ASCII white space only (space and 0x09-0x0D), which is what ``bytes.split`` does.

A word's hash is two polynomials modulo two primes just under 2^32, scrambled to 64 bits; different words of n bytes
collide with odds of about (n / 2^32)^2, also words built to collide modulo a power of two. Runs of words chain those
values through the same scrambling, so m runs hold a colliding pair with odds of about m^2 / 2^65: under 10^-8 for the
runs of a text of 100,000 words. Texts are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised code; a longer text is handled alone.
SLICE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no malloc_trim
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a session in one JVM may leave it unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/vigilake-shared"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB between the JVM and Python, where the session leaves Spark's 64: a task holds several at once on either side."""
    if spark.conf.get(_BATCH_BYTES) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_BYTES, "8m")


def settle(df: DataFrame, keep: str = "table") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{keep}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide_hash(col: Column) -> tuple[Column, Column]:
    """Two 64-bit digests of a text, 128 bits together."""
    return F.xxhash64(col), F.xxhash64(F.lit(7), col)


def text_digest(col: Column) -> tuple[Column, Column]:
    """The first 128 bits of a text's SHA-256 as two longs, never null, so that no join on them filters; 0 for null."""
    code = F.sha2(col, 256)
    part = lambda at: F.coalesce(F.conv(F.substring(code, at, 16), 16, -10).cast("long"), F.lit(0))
    return part(1), part(17)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns renamed c0, c1, ... so that no name of an operator's own can clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def release() -> None:
    """Give memory that is free back to the system: Python workers wait between tasks, and would keep it all that time."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE_BYTES of text; memory is given back after it."""
    yield from _slices(batch, column)
    release()


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    text = batch.column(column)
    if not batch.num_rows:
        return
    offsets = _offsets(text)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _offsets(text: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PRIMES = (4_294_967_291, 4_294_967_279)  # the largest two below 2^32
_SUM_BYTES = 1 << 23  # so many terms of under 2^41 add up to less than 2^64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int, prime: int) -> np.ndarray:
    """1, base, base^2, ... modulo a prime below 2^32, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done, step = done + more, step * step % prime
    return out


def _powers(n: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo the prime, and of its inverse."""
    if prime not in _POWERS or len(_POWERS[prime][0]) < n:
        size, base = max(n, SLICE_BYTES + (1 << 16)), _BASE % prime
        _POWERS[prime] = tuple(_geometric(b, size, prime).astype(np.uint32) for b in (base, pow(base, -1, prime)))
    return _POWERS[prime]


def _polynomials(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, prime: int) -> np.ndarray:
    """Of each stretch of bytes: sum of (byte + 1) * base^place modulo the prime."""
    up, down = _powers(len(data), prime)
    total = np.zeros(len(data) + 1, np.uint64)
    np.add(data, 1, out=total[1:], dtype=np.uint64)
    total[1:] *= up[: len(data)]
    if len(data) > _SUM_BYTES:
        total %= np.uint64(prime)
    np.cumsum(total, out=total)
    return (total[ends] - total[begins]) % np.uint64(prime) * down[begins] % np.uint64(prime)


def word_counts(text: pa.Array) -> np.ndarray:
    """How many words each row has; none in null."""
    offsets = _offsets(text)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(len(text), np.int64)
    offsets = offsets - first
    begins = ~_IS_SPACE[np.frombuffer(text.buffers()[2], np.uint8)[first:last]]
    edge = np.zeros(last - first + 1, bool)
    edge[offsets] = True
    begins[1:] &= ~begins[:-1] | edge[1:-1]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


class Words:
    """The words of a column of texts: hash (uint64) of each, and bounds: row i has words bounds[i]:bounds[i+1]."""

    def __init__(self, text: pa.Array, fold: bool = False):
        offsets = _offsets(text)
        first, last = int(offsets[0]), int(offsets[-1])
        offsets = offsets - first
        data = np.frombuffer(text.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        if fold:
            data = _FOLD[data]
        n = len(data)
        if not n:
            self.hash, self.bounds = np.zeros(0, np.uint64), np.zeros(len(text) + 1, np.int64)
            return
        solid = ~_IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends[:-1] &= ~solid[1:] | edge[1:n]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        high, low = (_polynomials(data, begins, ends, p) for p in _PRIMES)
        self.hash = mixed(mixed(high << np.uint64(32) | low) + (ends - begins).astype(np.uint64))
        self.bounds = np.searchsorted(begins, offsets).astype(np.int64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (fewer at the very end of the column, where the value means nothing)."""
        out = np.zeros(len(self.hash), np.uint64)
        for j in range(min(k, len(self.hash))):
            out[: len(out) - j] = mixed(out[: len(out) - j] * np.uint64(_BASE) + self.hash[j:])
        return out


def shingle_sets(text: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, A-Z lower-cased: (hashes, bounds), sorted inside a row.

    A row with fewer than k words has one shingle, its whole sequence; a row without words has none.
    """
    w = Words(text, fold=True)
    g, b = w.grams(k), w.bounds
    n = np.diff(b)
    rows = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(g)) + k <= b[1:][rows] if len(g) else np.zeros(0, bool)
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = int(n[i])
        for x in w.hash[b[i] : b[i + 1]].tolist():
            h = int(mixed(np.array([(h * _BASE + x) % (1 << 64)], np.uint64))[0])
        g[b[i]], inside[b[i]] = h, True
    rows, g = rows[inside], g[inside]
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
        rows, g = rows[keep], g[keep]
    return g, np.searchsorted(rows, np.arange(len(n) + 1))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
