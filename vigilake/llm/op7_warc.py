"""WARC: write archives, normalise monolithic gzip files to one member per record with an offset index, read back.

1. Payload digests are grouped (pre-aggregated); the smallest page_id of equal payloads is the response, others are
   revisits of it. Only digests meet by payload, so copies of one page, however many, are not brought together.
2. Each task writes its records as one gzip stream, a monolithic file, to the shared folder. Names carry the task
   attempt, and only files named in a finished task's row are read, so lost executors leave no half file in use.
3. The normaliser inflates each file once as a stream, whatever its size, rewrites each record as a gzip member of
   its own and writes a sidecar index (offset, length, type, record id).
4. Reading back seeks each member by the index and inflates it alone, as a stream: of a payload no more than a block is held.
   Small archives share a task.

Nulls, ties: a null html is an empty payload, a null url has no target line. A null page_id comes after all others.
Rows with the smallest page_id of a payload are all responses if there are several; rows that repeat a page_id are records
of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_folder, slices, table

LEAST_REVISIT = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
TASK_BYTES = 64 << 20  # of archives that one task normalises or reads
READ_ROWS = 1_000  # records that a reader holds at once


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class _Inflated:
    """Bytes of a gzip file of one or more members, inflated once, in bounded memory."""

    def __init__(self, file):
        self.file, self.zip, self.held, self.at = file, zlib.decompressobj(31), b"", 0

    def more(self) -> bool:
        raw = self.zip.unconsumed_tail
        if self.zip.eof:
            raw, self.zip = self.zip.unused_data, zlib.decompressobj(31)
        raw = raw or self.file.read(_CHUNK)
        data = self.zip.decompress(raw, _CHUNK) if raw else self.zip.flush()
        self.held, self.at = self.held[self.at :] + data, 0
        return bool(raw or data)

    def head(self) -> bytes | None:
        """Up to the blank line; None at the end."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out, self.at = self.held[self.at : end + 4], end + 4
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends inside a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            if part:
                yield part


def normalise(source, target) -> list[tuple[int, int, str, str]]:
    """Rewrite an archive with one gzip member for each record: (offset, length, type, record id) of each."""
    stream, index, offset = _Inflated(source), [], 0
    while (head := stream.head()) is not None:
        h = headers(head)
        member, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for part in ([head], stream.body(int(h["content-length"]) + 4)):
            for data in part:
                size += _put(target, member.compress(data))
        size += _put(target, member.flush())
        index.append((offset, size, h["warc-type"], h["warc-record-id"]))
        offset += size
    return index


def _put(target, data: bytes) -> int:
    if data:
        target.write(data)
    return len(data)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = zipped = None
        n = size = 0
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    if out is None:
                        fs, path = _store(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out, zipped = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += _put(out, zipped.compress(record(row["page_id"], row["url"], row["html"].encode(), row["record_type"], row["refers_to"])))
                    n += 1
        if out is not None:
            size += _put(out, zipped.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    return run


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            name = row["path"].removesuffix(".warc.gz") + f"-n{TaskContext.get().taskAttemptId()}.warc.gz"
            fs, path = _store(row["path"])
            made = path.removesuffix(row["path"].rpartition("/")[2]) + name.rpartition("/")[2]
            with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(made, compression=None) as target:
                index = normalise(source, target)
            if len(index) != row["records"]:
                raise ValueError(f"{path}: {len(index)} records of {row['records']}")
            with fs.open_output_stream(made + ".idx", compression=None) as side:
                side.write("".join(f"{o} {n} {kind} {key}\n" for o, n, kind, key in index).encode())
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [len(index)], "bytes": [sum(n for _, n, _, _ in index)]})


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    h = headers(head)
    return h, rest[: int(h["content-length"])]


def _inflated(file, length: int) -> Iterator[bytes]:
    """A member's bytes in blocks."""
    inflate = zlib.decompressobj(31)
    while length > 0 and (raw := file.read(min(length, _READ))):
        length -= len(raw)
        while raw:
            yield inflate.decompress(raw, _READ)
            raw = inflate.unconsumed_tail
    yield inflate.flush()


def _upto(held: bytes, source: Iterator[bytes]) -> tuple[bytes, bytes]:
    """What stands before the next empty line, and what was read behind it. Heads are short; one of over a megabyte is none."""
    while b"\r\n\r\n" not in held:
        more = next(source, None)
        if more is None or len(held) > 1 << 20:
            raise ValueError("a record without the end of its head")
        held += more
    head, _, rest = held.partition(b"\r\n\r\n")
    return head, rest


def streamed_member(file, length: int) -> tuple[dict[str, str], bytes, int, str]:
    """Headers of a record, of its HTTP message, size and base-32 SHA-1 of the payload, of which no more than a block is held."""
    source = _inflated(file, length)
    head, rest = _upto(b"", source)
    h = headers(head)
    http, rest = _upto(rest, source)
    left = size = int(h["content-length"]) - len(http) - 4
    sha = hashlib.sha1()
    for block in itertools.chain([rest], source):
        sha.update(block[:left])
        left -= min(left, len(block))
    if left:
        raise ValueError("a record is shorter than its head says")
    return h, http, size, base64.b32encode(sha.digest()).decode()


_READ = 1 << 16
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _records(path: str) -> Iterator[tuple]:
    fs, at = _store(path)
    with fs.open_input_stream(at + ".idx", compression=None) as side:
        index = [line.split(" ") for line in side.read().decode().splitlines()]
    with fs.open_input_file(at) as file:
        for offset, length, kind, key in index:
            file.seek(int(offset))
            h, http, held, found = streamed_member(file, int(length))
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
            if h["warc-type"] != kind or h["warc-record-id"] != key or kind == "response" and (found != digest or held != size):
                raise ValueError(f"{path} at {offset}: the record does not match its index or digest")
            number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
            yield number("x-page-id"), size, digest, kind, number("x-refers-to-page"), h.get("warc-target-uri"), path, int(offset), int(length)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = _records(path)
            while some := list(itertools.islice(found, READ_ROWS)):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), _RECORD.types)], schema=_RECORD)


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages with record_type and refers_to. A payload's copies meet by digest alone, then each page its own role."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    copies = base.groupBy("page_id", "sha", "n").agg(F.lit(1).alias("one"))
    firsts = copies.groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("n") < least)
    roles = copies.join(firsts, ["sha", "n"]).select(
        F.col("page_id").alias("of_page"), F.col("sha").alias("of_sha"), F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first")).alias("refers_to")
    )
    mine = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha") == F.col("of_sha"))
    return base.join(roles.hint("merge"), mine).select("page_id", "url", "html", "record_type", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Monolithic archives: path, records and bytes of each."""
    return settle(plan_records(pages, least).mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


def _shared_out(archives: DataFrame) -> DataFrame:
    """Archives dealt to tasks of about TASK_BYTES, but to as many as can run at once if there are enough archives."""
    tally = archives.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    wide = max(archives.sparkSession.sparkContext.defaultParallelism, -(-tally["bytes"] // TASK_BYTES))
    return archives.repartition(max(1, min(tally["n"], wide)))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """One member for each record, and a sidecar index, beside each archive: path, records and bytes of each."""
    return settle(_shared_out(archives).mapInArrow(_normalise, "path string, records long, bytes long"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    return _shared_out(archives).mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long, length long"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = normalise_archives(write_archives(table(spark, sf_dir, "pages"), folder))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
b as (select page_id, n, h, array_to_string(list_transform(generate_series(1, 40), lambda i:
  (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', substr(h, i, 1))]), '') as bits from d),
e as (select page_id, n, h, array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
  + 16 * cast(substr(bits, 5 * j + 1, 1) as int) + 8 * cast(substr(bits, 5 * j + 2, 1) as int) + 4 * cast(substr(bits, 5 * j + 3, 1) as int)
  + 2 * cast(substr(bits, 5 * j + 4, 1) as int) + cast(substr(bits, 5 * j + 5, 1) as int), 1)), '') as dig from b),
m as (select *, min(page_id) over (partition by h, n) as f from e)
select page_id, cast(n as bigint) as payload_bytes, dig as payload_digest, case when page_id is not distinct from f then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from f then f end as refers_to from m
"""
