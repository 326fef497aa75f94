"""Fill-in-middle: texts cut at two of their units and told in another order, by bit-parallel big integers.

A text's UTF-8 bytes are translated to a mask of zeros and ones for each class of bytes (ends of units, first bytes of
code points), and a mask is read as one big integer whose bit i is byte i. Shifted and combined masks mark where units
begin; bit_count gives their number and the code points of a stretch; the k-th beginning is found by halving: the half
that holds it is known from the bits of the lower one. Each mask and each search is linear in the text.

Units are lines ([^\\n]*\\n|[^\\n]+) or, with unit="words", runs without ASCII white space with the white space behind them
(white space at the very start is a unit of its own). The cuts, whether a text is reordered and in which form come from
the first four 32-bit words of sha256("<seed>:<doc_id>"), so reruns agree.

restore() gives the text back from output and form alone: no marker stands in a text that is reordered, and none
ends as it begins, so the first place of a marker is the one that was put there.

Nulls, ties: a null text is empty, so plain with 0 units. A null doc_id is hashed as the empty text. Every row gives one
row, rows that repeat give equal ones. A text that holds a marker stays plain. Texts of any length are handled whole;
masks of a text take about an eighth of its bytes, while being made twice its bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are reordered, and of these that come suffix first.
RATE, SUFFIX_FIRST = 100, 50

_BREAK = bytes(49 if b == 10 else 48 for b in range(256))
_SPACE = bytes(49 if b in b" \t\n\v\f\r" else 48 for b in range(256))
_FIRST = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))  # continuation bytes begin no code point


def mask(data: bytes, ones: bytes) -> int:
    """Bit i tells whether byte i is of the class for which the table `ones` has a one."""
    return int(data.translate(ones)[::-1], 2) if data else 0


def line_starts(data: bytes) -> int:
    """Bits of the bytes that begin a line: the first, and each after a line break."""
    n = len(data)
    return ((mask(data, _BREAK) << 1) | 1) & ((1 << n) - 1) if n else 0


def word_starts(data: bytes) -> int:
    """Bits of the first byte and of each that is no white space but follows some."""
    n = len(data)
    space = mask(data, _SPACE)
    return ((space << 1) & ~space | 1) & ((1 << n) - 1) if n else 0


STARTS = {"lines": line_starts, "words": word_starts}


def select(bits: int, k: int, width: int) -> int:
    """The place of the k-th one (from 0) among the lowest `width` bits; there are more than k."""
    place = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        ones = low.bit_count()
        if k < ones:
            bits, width = low, half
        else:
            bits, width, k, place = bits >> half, width - half, k - ones, place + half
    return place


def cut(data: bytes, starts: int, units: int, after: int) -> int:
    """Where the first `after` of a text's units end."""
    return len(data) if after >= units else select(starts, after, len(data))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must differ, and none may end as it begins, or it could be found where it was not put."""
    if len(set(markers)) < 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for m in markers:
        if any(m.endswith(m[:i]) for i in range(1, len(m))):
            raise ValueError(f"the marker {m!r} ends as it begins")


_OUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def reorder(text: str, h: tuple[int, int, int, int], starts_of, rate: int, suffix_first: int, markers: tuple[str, str, str]) -> tuple:
    """Units, form, code points of prefix and middle, output."""
    data = text.encode()
    starts = starts_of(data)
    n = starts.bit_count()
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((cut(data, starts, n, h[0] % (n + 1)), cut(data, starts, n, h[1] % (n + 1))))
    firsts = mask(data, _FIRST)
    before = (firsts & ((1 << a) - 1)).bit_count()
    inside = (firsts & ((1 << b) - 1)).bit_count() - before
    p, s, m = (x.encode() for x in markers)
    front, middle, back = data[:a], data[a:b], data[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", before, inside, b"".join((s, back, p, front, m, middle)).decode()
    return n, "psm", before, inside, b"".join((p, front, s, back, m, middle)).decode()


def fill_in_middle(docs: DataFrame, unit: str = "lines", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs (doc_id, text): doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output. markers: of prefix, suffix, middle. No shuffle."""
    _check(markers)
    starts_of = STARTS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                drawn = zip(*(part.column(f"h{i}").to_pylist() for i in range(4)))
                rows = [reorder(text, h, starts_of, rate, suffix_first, markers) for text, h in zip(part.column("text").to_pylist(), drawn)]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _OUT))], ["doc_id", *(name for name, _ in _OUT)])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of."""
    behind = lambda text, head, marker: F.substring(text, F.length(head) + 1 + len(marker), F.length(text))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = behind(rest, one, second)
        two = F.substring_index(rest, markers[2], 1)
        return one, two, behind(rest, two, markers[2])

    front, back, middle = parts(markers[0], markers[1])
    psm = F.concat(front, middle, back)
    back, front, middle = parts(markers[1], markers[0])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(front, middle, back)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || cast(doc_id as varchar)) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines,
  cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from t),
c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:], '') as suffix from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
