import hashlib
import unicodedata

import pytest
from data import documents, frame
from vigilake.llm import op4_fingerprints as op4


def canon(text):
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return " ".join(nfkc(nfkc(text).casefold()).split())


def brute(rows):
    docs = sorted(rows, key=lambda r: r[0])
    out = []
    for i, r in enumerate(docs):
        text, following = r[1] or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(text) == canon(edited)), float(canon(text) == canon(following)), canon(text), canon(edited)))
    return out


ROWS = [r for i, r in enumerate(documents()) if r[0] is not None and i < 66]
ROWS = list({r[0]: r for r in ROWS}.values()) + [(2000, "ﬁne Straße  x", None, None, None), (2001, "FINE strasse X ", None, None, None), (2002, "A", None, None, None), (2003, "😀é é", None, None, None), (-5, "first", None, None, None)]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_same_as_brute_force(spark, ranges):
    got = sorted(map(tuple, op4.fingerprints(frame(spark, ROWS), ranges).collect()))
    want = brute(ROWS)
    assert [(g[0], g[1], g[2], g[5], g[6]) for g in got] == [w[:5] for w in want]
    by_text, by_print = {}, {}
    for g, w in zip(got, want):
        for f, c in ((g[3], w[5]), (g[4], w[6])):
            assert by_text.setdefault(c, f) == f and by_print.setdefault(f, c) == c


def test_nulls_repeats_empty(spark):
    rows = [(None, "x", None, None, None), (None, None, None, None, None), (7, "y", None, None, None), (7, "y", None, None, None), (7, "z", None, None, None)]
    got = op4.fingerprints(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r.fingerprint and r.edited_sha256 for r in got)
    assert op4.fingerprints(frame(spark, [], 1)).count() == 0
    one = op4.fingerprints(frame(spark, [(1, "abc", None, None, None)], 1)).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_no_python_in_the_plan(spark):
    plans = [*op4.digests(frame(spark, ROWS)), op4.fingerprints(frame(spark, ROWS))]
    text = "".join(df._jdf.queryExecution().toString() for df in plans)
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("ranges", [1, 4, 32])
def test_many_rows_without_or_with_one_doc_id(spark, ranges):
    rows = [(None, f"no id {i}", None, None, None) for i in range(200)] + [(7, f"seven {i}", None, None, None) for i in range(200)] + [(7, "again", None, None, None)] * 5
    rows += [((1 << 63) - 1, "last", None, None, None), (-(1 << 63), "first", None, None, None)]
    got = op4.fingerprints(frame(spark, rows), ranges).collect()
    assert len(got) == len(rows)
    halves = {hashlib.sha256((a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode()).hexdigest() for a in rows for b in rows}
    assert {r.edited_sha256 for r in got} <= halves
    assert sum(r.near_next for r in got) == 4  # the equal rows follow each other
    # after the last id come those without; after them the first of all
    edited = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    last = next(r for r in got if r.doc_id == (1 << 63) - 1)
    assert last.edited_sha256 == edited("last", "no")
    assert sum(r.edited_sha256 in {edited(f"no id {i}", "first") for i in range(200)} for r in got if r.doc_id is None) == 1


def test_buckets_of_different_texts_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op4, "wide_hash", lambda c: (F.length(c).cast("long") % 3, F.lit(0).cast("long")))  # nearly all digests collide
    got = sorted(map(tuple, op4.fingerprints(frame(spark, ROWS), 3).collect()))
    by_print = {}
    for g, w in zip(got, brute(ROWS)):
        assert (g[5], g[6]) == w[3:5]
        for f, c in ((g[3], w[5]), (g[4], w[6])):
            assert by_print.setdefault(f, c) == c


@pytest.mark.parametrize("ranges,equal", [(3, 10), (16, 100), (4, 10**6)])
def test_equal_rows_are_told_as_one(spark, ranges, equal):
    rows = ROWS + [(2500, "again and again é", None, None, None)] * 700 + [(2600, None, None, None, None)] * 300 + [(2700, "x", None, None, None)] * 5
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in op4.fingerprints(frame(spark, rows), ranges, equal).collect())
    assert got == sorted(w[:5] for w in brute(rows))
    same = [(1, "all the same", None, None, None)] * 400
    got = op4.fingerprints(frame(spark, same), ranges, equal).collect()
    assert len(got) == 400 and {r.near_next for r in got} == {1.0} and len({r.edited_sha256 for r in got}) == 1
    base, _ = op4.digests(frame(spark, rows), ranges, equal)
    assert "Python" not in base._jdf.queryExecution().toString()
