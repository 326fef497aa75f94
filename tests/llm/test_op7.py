import base64
import gzip
import hashlib
import io
import zlib

import pytest
from vigilake.llm import op7_warc as op7

SCHEMA = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7}</p>" * (i % 5) + "é\r\n\r\nWARC/1.1\r\n" * (i % 2)) for i in range(40)]
    return rows + [(100, None, None), (101, "http://a b\nc", ""), (102, "u", "z" * 3_000_000), (None, "n", "page only here"), (None, "n", "<p>page 1</p>")]


def brute(rows):
    first = {}
    for i, _, h in rows:
        k = h or ""
        if i is not None:
            first[k] = min(first.get(k, i), i)
    out = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    made = op7.write_archives(df, f"file://{tmp_path}/w")
    whole = made.first().path.removeprefix("file://")
    assert len(zlib.decompressobj(31).decompress(open(whole, "rb").read())) == len(gzip.open(whole).read())  # one member
    norm = op7.normalise_archives(made)
    back = op7.read_archives(norm)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in back.select(names).collect()), key=str) == brute(pages())
    one = norm.first().path.removeprefix("file://")
    a, b = gzip.open(one).read().split(b"WARC/1.1\r\nWARC-Type"), sum(1 for _ in open(one + ".idx"))
    assert len(a) == b + 1


def test_many_members_and_broken_archives():
    r = [op7.record(i, "u", b"x" * (i * 300_000), "response", None) for i in range(9)]
    target = io.BytesIO()
    index = op7.normalise(io.BytesIO(gzip.compress(r[0] + r[1]) + gzip.compress(b"".join(r[2:]))), target)
    assert len(index) == 9
    for (offset, length, _, _), raw in zip(index, r):
        assert zlib.decompress(target.getvalue()[offset : offset + length], 31) == raw
    for bad in (r[1][:-50], b"nonsense\r\n\r\n", b"WARC/1.1\r\nWARC"):
        with pytest.raises(ValueError):
            op7.normalise(io.BytesIO(gzip.compress(bad)), io.BytesIO())


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert op7.read_archives(op7.normalise_archives(op7.write_archives(df, f"file://{tmp_path}/e"))).count() == 0


def test_a_long_record_is_read_in_blocks(tmp_path):
    import tracemalloc

    payload = b"long page\r\n\r\n" * 4_000_000
    member = gzip.compress(op7.record(7, "http://x", payload, "response", None), 1)
    (tmp_path / "a").write_bytes(b"before" + member + b"behind")
    with open(tmp_path / "a", "rb") as file:
        file.seek(6)
        tracemalloc.start()
        h, http, size, digest = op7.streamed_member(file, len(member))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert (size, digest) == (len(payload), op7.digest32(payload)) and h["warc-type"] == "response" and peak < 2_000_000
    short = gzip.compress(op7.record(7, "http://x", payload[:100], "response", None)[:-60])
    with pytest.raises(ValueError):
        op7.streamed_member(io.BytesIO(short), len(short))
    with pytest.raises(ValueError):
        op7.streamed_member(io.BytesIO(gzip.compress(b"no head at all")), 40)
