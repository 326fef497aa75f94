import hashlib
import re

import pytest
from data import documents, frame
from vigilake.llm import op1_substring_dedup as op1
from vigilake.llm.automaton import SuffixAutomaton, matching_statistics, repeated_spans


def brute(rows, window=20):
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            if k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((r[0], *out[r[0], r[1]]) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [1, 4, 256])
def test_same_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op1, "HOT", hot)
    rows = documents()
    assert result(op1.remove_repeats(frame(spark, rows))) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert op1.remove_repeats(frame(spark, [], 1)).count() == 0
    from pyspark.sql import functions as F

    df = frame(spark, documents(20)).withColumns({c: F.lit(1) for c in ("h1", "home", "n_words", "start", "spans")})
    assert result(op1.remove_repeats(df)) == brute(documents(20))


def test_statistics_of_a_broadcast_reference(spark):
    a = SuffixAutomaton()
    for w in "a b c a b d".split():
        a.extend(w)
    assert matching_statistics(a, "x a b d c a b c".split()) == [0, 1, 2, 3, 1, 2, 3, 3]
    words = "the cat sat on a mat " * 6
    df = frame(spark, [(1, "zz " + words + " yy", None, None, None), (2, None, None, None, None)], 1)
    assert [tuple(r) for r in op1.broadcast_spans(spark, df, [words]).collect()] == [(1, 1, 37)]
    with pytest.raises(ValueError):
        op1.broadcast_spans(spark, df, [words], max_words=3)


def test_online_spans_against_all_windows():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        a, seen = SuffixAutomaton(), set()
        for _ in range(5):
            words = rnd.choices("ab" if rnd.random() < 0.5 else "abcdef", k=rnd.randint(0, 40))
            want = set()
            for s in range(len(words) - 3):
                k = tuple(words[s : s + 4])
                if k in seen:
                    want.update(range(s, s + 4))
                seen.add(k)
            got = {p for x, y in repeated_spans(a, words, 4) for p in range(x, y)}
            assert got == want
