"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from data import documents, frame
from pyspark.sql import functions as F
from vigilake.llm import op11_periodic_runs as op11


def brute(x, least=24, times=3):
    out, n = [], len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                part = x[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rnd = random.Random(5)
    for i in range(150):
        letters = rnd.choice([1, 2, 3, 30])
        x = [rnd.randrange(letters) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            word = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 14))]
            at = rnd.randrange(len(x) + 1)
            x[at:at] = (word * 12)[: rnd.randrange(8, 90)]
        yield x
    a, b = [0], [0, 1]
    while len(b) < 150:  # words of Fibonacci hold the most runs
        a, b = b, b + a
    yield b
    yield [0] * 200
    yield [0, 1] * 80 + [0, 1, 2] * 40 + [0] * 23 + [1] + [0] * 24


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (10, 4), (2, 2)])
def test_runs_equal_a_search_of_every_period(least, times):
    found = 0
    for x in sequences():
        want = brute(x, least, times)
        assert op11.runs(x, least, times) == want
        found += len(want)
    assert found > 50


def test_large_sets_of_ends():
    x = [0] * 3000 + [1] + [0, 1, 2] * 900
    assert op11.runs(x) == [(0, 3000, 1), (3001, 2700, 3)]
    ends = op11.Ends(700)
    rnd, known = random.Random(2), {700}
    for p in rnd.sample(range(5000), 900):
        if p in known:
            continue
        before, behind = max((x for x in known if x < p), default=None), min((x for x in known if x > p), default=None)
        assert ends.add(p) == (before, behind)
        known.add(p)
    order = sorted(known)
    assert list(ends) == order and ends.size == len(order)
    assert all(ends.next_is(a, b) for a, b in zip(order, order[1:])) and not ends.next_is(order[0], order[2])


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words) if n < 3000 else op11.runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows():
    out = documents(120)
    rnd = random.Random(8)
    for i in range(60):
        head, tail = (" ".join(f"h{rnd.randrange(50)}" for _ in range(rnd.randrange(30))) for _ in range(2))
        unit = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
        out.append((2000 + i, f"{head} {' '.join([unit] * rnd.randrange(2, 20))}\n{tail}", "en", "s1", None))
    return out + [(3000, "x " * 70_000, "en", "s1", None), (3001, "    é " * 30, None, None, None)]


def test_the_query(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((expected(r[0], r[1]) for r in rows()), key=str)
    assert got == want and sum(r[1] for r in want) > 60 and any(r[1] > 1 for r in want)


def test_real_text_and_its_spans(spark):
    some = [(1, "intro " + "la di da " * 10 + "outro", "en", "s", None), (2, None, None, None, None), (1, "", "en", "s", 0)]
    got = {(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in op11.find_runs(frame(spark, some)).collect()}
    assert got == {(1, ((1, 30, 3),), "intro la di da outro"), (2, (), ""), (1, (), "")}
    with pytest.raises(ValueError):
        op11.find_runs(frame(spark, some), times=1)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in op11.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()))
    short = docs.where(F.length("text") < 4000).select("doc_id", "text").collect()
    want = {r.doc_id: expected(r.doc_id, r.text) for r in short}
    assert len(got) == docs.count() and all(r == want[r[0]] for r in got if r[0] in want)
    assert sum(r[1] for r in got) > 10
