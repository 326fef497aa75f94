"""The knowledge base against plain loops over every pattern."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from vigilake.functions import rules as R
from vigilake.operators import factors, knowledge, vectors

RULES = [
    "execute", r"exec\w*\(", r"\bos\.system\s*\(", "select|insert", "(?:eval|exec)u?te?", "a{2,}b", "ab?c", "x*", "", "(broken", "[ks]ql", r"\w+\s*\(", "(?i:QUERY)", "open(?=file)", "(cursor)+", "kelvin", "is_s", r"(a|b)cde",
    "(?x) sys tem  # note", "p.pen", "sub(process)?run", "(?:re)?direct", r"\.inner(?:HTML|Text)", "\u017fk", "(?:ab|cd|ef|gh|ij|kl|mn|op|qr)xyz",
]
TEXTS = ["cur.execute(q)", "OS.SYSTEM (x)", "xyz redirectabc", "\u212aELVIN \u0130S_\u017f", "eval(", "aab acc", "", None, "selECT * from sql", "el.innerHTML = popen", "subprocessrun", "abxyz qrxyz", "plain words only", "request.input render", "system", "acde bcde cursorcursor"]


def loop(snippets, patterns, k=3):
    out = []
    for sid, text, kind in snippets:
        text = text or ""
        scored = []
        for pid, cwe, signature, code, rule, seen in patterns:
            points = 3 * (R.HOOK_TYPE_CWE.get(kind) is not None and R.HOOK_TYPE_CWE.get(kind) == cwe)
            for worth, r in ((5, rule), (4, signature)):
                try:
                    points += worth * bool(r and re.search(r, text, re.I))
                except re.error:
                    pass
            points += min(3, sum(w.lower() in text.lower() and w.lower() in (code or "").lower() for w in R.RETRIEVAL_WORDS))
            if points:
                scored.append((-float(points), -(seen or 0), pid is None, pid or 0))
        out.append((sid, tuple((n, p, None if null else pid) for n, p, null, pid in sorted(scored)[:k])))
    return sorted(out, key=str)


def test_what_a_rule_requires_stands_in_all_that_it_matches():
    rnd = random.Random(1)
    letters = "abcdeksiqulexprt\u212a\u017f\u0130\u0131.(){ _"
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    met = 0
    for rule in RULES:
        if factors.compiled(rule) is None:
            assert not rule or rule == "(broken"
            continue
        needed, places = factors.required(rule), factors.key_places(rule)
        known = factors.bitmap(places or [])
        for t in texts:
            if re.search(rule, t, re.I):
                met += 1
                low = factors.fold(t)
                assert needed is None or any(x in low for x in needed), (rule, t)
                assert places is None or set(places) & set(factors.places_in(low, known)), (rule, t)
    assert met > 300
    assert factors.required("execute") == {"execute"} and factors.required("select|insert") == {"select", "insert"} and factors.required("x*") is None
    assert factors.required(r"\bos\.system\s*\(") == {"os.system"} and factors.required("(cursor)+") == {"cursor"}


def test_no_other_letter_equals_an_ascii_one():
    every = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(every)
    assert {c for c in re.findall("[a-z]", text, re.I)} == set("\u212a\u0130\u0131\u017f")


SCHEMA = "pid long, cwe_id string, code_signature string, vulnerable_snippet string, detection_rule string, seen long"


def test_ten_thousand_rules_as_by_a_loop(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "FREE", 40)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(3, 7))) for _ in range(400)]
    patterns = []
    for i in range(10_000):
        rule = rnd.choice([rnd.choice(words) + r"\s*\(" + rnd.choice(words), rnd.choice(words) + "|" + rnd.choice(words), None, rnd.choice(RULES) if rnd.random() < 0.02 else rnd.choice(words) + rnd.choice(words)])
        patterns.append((rnd.choice([None, i, i // 2, 7]), rnd.choice([None, "CWE-89", "CWE-78", "CWE-1"]), rnd.choice([None, "", rnd.choice(words) + rnd.choice(words)]), rnd.choice([None, "execute cursor", "none", "open( os."]), rule, rnd.choice([None, 1, i % 50])))
    patterns += patterns[:300]  # repeated rows
    snippets = [(rnd.choice([None, i, 5]), " ".join(rnd.choices(words, k=6)) + rnd.choice(["", " ("]) + rnd.choice(words), rnd.choice([None, "injection", "command_exec", "other"])) for i in range(25)]
    snippets += [(i, t, "injection") for i, t in enumerate(TEXTS)] + [snippets[0]] * 2
    got = knowledge.matched(spark.createDataFrame(snippets, "id long, snippet string, hook_type string"), spark.createDataFrame(patterns, SCHEMA).repartition(3))
    rows = sorted(((r.id, tuple(tuple(f) for f in r.found)) for r in got.collect()), key=str)
    assert rows == loop(snippets, patterns)


def test_ids_that_are_shared_or_null(spark):
    patterns = spark.createDataFrame([(None, "CWE-89", None, None, "execute", None, [1.0, 0.0]), (4, "CWE-78", None, None, "execute", 2, [0.0, 1.0]), (4, "CWE-22", None, None, "other", 2, [1.0, 0.1])], SCHEMA + ", v array<double>")
    snippets = spark.createDataFrame([(1, "cur.execute(a)", "injection", [1.0, 0.0]), (1, "cur.execute(b)", None, [0.0, 1.0]), (None, "plain words only", "x", [1.0, 0.0]), (None, "plain words only", "x", [1.0, 0.0])], "id long, snippet string, hook_type string, v array<double>")
    got = sorted(((r.id, r["rank"], r.pid) for r in knowledge.retrieve(snippets, patterns).collect()), key=str)
    assert got == sorted([(1, 1, None), (1, 2, 4), (1, 1, 4), (1, 2, None)] + [(None, 1, None), (None, 2, 4)] * 2, key=str)
    assert knowledge.matched(snippets, patterns.limit(0)).where(F.size("found") > 0).count() == 0 and knowledge.similar(snippets, patterns.limit(0)).count() == 4
    assert knowledge.matched(snippets.limit(0), patterns).count() == 0 and knowledge.similar(snippets.limit(0), patterns).count() == 0


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b or not all(map(math.isfinite, a + b)) or not any(a) or not any(b):
        return 0.0
    a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("least", [0.0, 0.3, 0.9])
def test_the_index_finds_what_a_loop_finds(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 800)
    monkeypatch.setattr(vectors, "SLICE", 7)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(9, 6)) * 4
    points = [(i, (centres[i % 9] + rnd.normal(size=6)).tolist()) for i in range(400)]
    points += [(1000 + i, points[i][1]) for i in range(20)] + [(None, points[3][1]), (5, points[3][1]), (7, points[7][1]), (2000, [1e200, -1e200, 0.0, 0.0, 0.0, 1.0]), (2001, None), (2002, [0.0] * 6), (2003, [1.0, 2.0]), (2004, [float("nan")] * 6), (2005, [])]
    queries = [(i, (centres[i % 9] + rnd.normal(size=6)).tolist()) for i in range(40)] + [(50, None), (51, [0.0] * 6), (52, [1.0, 1.0]), (53, [1.0]), (54, [1e-300] * 6), (0, [1.0] * 6), (None, [1.0] * 6)]
    kind = "long, v array<double>"
    got = knowledge.similar(spark.createDataFrame(queries, f"id {kind}"), spark.createDataFrame(points, f"pid {kind}").repartition(3), 4, least)
    want = []
    for qid, q in queries:
        scored = sorted((-round(cosine(q, p), 9), pid is None, pid or 0) for pid, p in points)
        want.append((qid, tuple((n, None if null else pid) for n, null, pid in scored[:4] if -n > least)))
    rows = [(r.id, tuple((round(f.negative, 9), f.pid) for f in r.found)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        knowledge.similar(spark.createDataFrame(queries, f"id {kind}"), spark.createDataFrame(points, f"pid {kind}"), 4, -1.0)


def test_far_cells_are_not_visited(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    centres = np.eye(8)
    points = spark.createDataFrame([(i, (centres[i % 8] + rnd.normal(size=8) * 0.01).tolist()) for i in range(800)], "pid long, v array<double>")
    queries = spark.createDataFrame([(str(i), centres[i % 8].tolist()) for i in range(16)], "key string, v array<double>")
    visits = []
    seen = vectors._visit
    monkeypatch.setattr(vectors, "_visit", lambda p, c, v, k, least: (visits.append(v.where("cell >= 0").count()), seen(p, c, v, k, least))[1])
    assert vectors.search(queries, points, 3, 0.3).count() == 48
    assert visits[0] == 16 and visits[1] < 16 * 29 / 4  # of 29 cells few can hold better ones
