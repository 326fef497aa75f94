"""Fill-in-middle against a plain cut, and exact round trips."""

import hashlib
import random
import re

import pytest
from data import documents, frame
from pyspark.sql import functions as F
from vigilake.llm import op12_fill_in_middle as op12


def plain(doc_id, text, seed=7, rate=100, suffix_first=50, pattern=r"[^\n]*\n|[^\n]+", markers=("<P>", "<S>", "<M>")):
    text = text or ""
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(pattern, text)
    n = len(units)
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    front, middle, back = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = markers
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(front), len(middle), s + back + p + front + m + middle
    return doc_id, n, "psm", len(front), len(middle), p + front + s + back + m + middle


def rows():
    rnd = random.Random(3)
    out = documents(80)
    for i in range(200):
        text = "".join(rnd.choice(["\n", "\n\n", "é", "日本\r\n", "😀 x", "<P", "S>", "<", "M>", "\x00", "a b\t", " ", " "]) for _ in range(rnd.randrange(12)))
        out.append((5000 + i, text, "en", "s", None))
    return out + [(6000, "ab<S>c\nd", None, None, None), (6001, "line\n" * 60_000 + "é" * 300_000, None, None, None), (6002, "\n", None, None, None), (6003, "x" * 700_000, None, None, None)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_a_plain_cut(spark):
    made = op12.fill_in_middle(frame(spark, rows()))
    want = sorted((plain(r[0], r[1]) for r in rows()), key=str)
    assert as_rows(made) == want and {r[2] for r in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", op12.restore(F.col("output"), F.col("form")).alias("text"))
    assert as_rows(back) == sorted(((r[0], r[1] or "") for r in rows()), key=str)


def test_words_rates_and_other_markers(spark):
    markers = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = op12.fill_in_middle(frame(spark, rows()), unit="words", seed=11, rate=60, suffix_first=20, markers=markers)
    want = sorted((plain(r[0], r[1], 11, 60, 20, r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", markers) for r in rows()), key=str)
    assert as_rows(made) == want
    back = made.select("doc_id", op12.restore(F.col("output"), F.col("form"), markers).alias("text"))
    assert as_rows(back) == sorted(((r[0], r[1] or "") for r in rows()), key=str)


@pytest.mark.parametrize("markers", [("a", "a", "b"), ("", "x", "y"), ("aba", "x", "y")])
def test_markers_that_could_be_mistaken(spark, markers):
    with pytest.raises(ValueError):
        op12.fill_in_middle(frame(spark, rows()), markers=markers)


def test_select_and_masks():
    rnd = random.Random(4)
    for width in (1, 2, 3, 64, 1000, 4097):
        bits = rnd.getrandbits(width) | 1
        ones = [i for i in range(width) if bits >> i & 1]
        assert [op12.select(bits, k, width) for k in range(len(ones))] == ones
    assert op12.line_starts(b"a\nb\n\n") == 0b10101 and op12.line_starts(b"") == 0 and op12.line_starts(b"\n\n") == 0b11


def test_the_query(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((*plain(r[0], r[1])[:5], sha(plain(r[0], r[1])[5]), sha(r[1] or "")) for r in rows()), key=str)
    assert as_rows(op12.op12_fill_in_middle(spark, str(tmp_path))) == want
