import random
import re
import time
import tracemalloc

import pytest
from data import documents, frame
from vigilake.llm import op8_license_scans as op8

TEXTS = [
    "Released under the MIT License. mit\nLICENSE mit-license", "GNU General Public License, version 3; Apache License 2.0", "permit license, amit license", "", None,
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest", "SPDX-License-Identifier: MIT OR", "SPDX-License-Identifier: ((MIT)",
    "mit license mit license", "licensed under CC BY-NC 4.0.", "the MIT License", "/* SPDX-License-Identifier: BSD-3-Clause */", "lesser general public license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, v) for p, v in op8.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))


def test_base_columns(spark):
    rows = documents() + [(3000 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = sorted((tuple(r) for r in op8.license_scan(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert op8.license_scan(frame(spark, [], 1)).count() == 0


def brute_labels(text):
    """Labels, tags and score by plain search, for texts whose expressions hold no brackets."""
    _, n, _, _, base = brute(text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, n_added = set(filter(None, base.split(","))), 0
    for phrase, label in op8.ADDED.items():
        p = phrase.split()
        found = sum(words[i : i + len(p)] == p for i in range(len(words)))
        n_added += found
        labels |= {label} if found else set()
    n_tags = 0
    for line in re.findall(r"(?i)spdx-license-identifier:[ \t]*([A-Za-z0-9.+-]+(?: +(?:or|and) +[A-Za-z0-9.+-]+)*)", text or ""):
        n_tags += 1
        labels |= {op8.family(x.rstrip(".:")) for x in re.split(r" +(?:or|and|OR|AND) +", line)}
    k = n + n_added + 2 * n_tags
    return ",".join(sorted(labels)), 1 - 0.5**k


def test_labels_as_by_plain_search(spark):
    texts = [t for t in TEXTS if "(" not in (t or "") and "MIT OR" not in (t or "")]
    texts += ["SPDX-License-Identifier: GPL-2.0-only OR MIT, see there", "text SPDX-License-Identifier: ISC. More words follow", "BSD 3 clause; CC0 1.0 and GNU LGPL " * 7, 'printf("SPDX-License-Identifier: MIT");']
    rows = documents() + [(5000 + i, t, None, None, None) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.labels, r.score) for r in op8.license_scan(frame(spark, rows)).collect()}
    assert got == {(r[0], *brute_labels(r[1])) for r in rows}


def test_labels_and_scores():
    m = op8._machine()
    r = op8.scan(m, TEXTS[5])
    assert r[5] == "apache,gpl,mit" and r[7:] == (1, 0, "Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0 AND MIT") and r[6] == 0.75
    assert [op8.scan(m, t)[7:9] for t in TEXTS[6:8]] == [(0, 1), (0, 1)]
    assert op8.scan(m, TEXTS[9])[5] == "cc-by,cc-by-nc" and op8.scan(m, TEXTS[11])[5] == "bsd" and op8.scan(m, TEXTS[12])[4:6] == ("gpl", "gpl,lgpl")
    assert op8.scan(m, "mit license " * 90)[6] == 1.0 and op8.scan(m, "")[6] == 0.0
    for text, labels in (
        ('{"name": "x", "license": "MIT OR Apache-2.0"}', "apache,mit"), ("license = 'BSD-3-Clause'", "bsd"), (" * @license ISC\n", "isc"),
        ('"license": "SEE LICENSE IN x"', ""), ("license = load(path)", ""), ("the license is good", ""), ("(SPDX-License-Identifier: MIT) and so on", "mit"),
    ):
        assert op8.scan(m, text)[5] == labels, text


def test_expressions():
    assert op8.postfix("a OR b AND c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert op8.choices(op8.postfix("(a or b) and c")) == {frozenset("ac"), frozenset("bc")}
    assert op8.postfix("a b") == ["a"] and op8.postfix("a) x") == ["a"] and op8.postfix("a ~ b") == ["a"] and op8.postfix("MIT.") == ["MIT"]
    for bad in ("", "(a", "and a", "a (b)", "()", "a or", "a or)", "~"):
        with pytest.raises(ValueError):
            op8.postfix(bad)
    with pytest.raises(ValueError):
        op8.licences(op8.postfix("(a or b) with c"))


def test_hostile_texts():
    m = op8._machine()
    r = op8.scan(m, "SPDX-License-Identifier: " + " AND ".join(f"(MIT OR x{i})" for i in range(40)))
    assert r[7:9] == (1, 0) and r[5].startswith("mit,x0,") and r[9].startswith("MIT x0 or")
    assert op8.scan(m, "SPDX-License-Identifier: " + "(" * 100_000)[7:9] == (0, 1)
    r = op8.scan(m, "mit license " * 100_000)
    assert r[:4] == (200_000, 100_000, 0, 199_998)
    assert op8.scan(m, "license " * 100_000 + " " * 100_000)[:2] == (100_000, 0)


@pytest.mark.parametrize(
    "text,tags",
    [
        ("SPDX-License-Identifier:" * 44_000, (0, 44_000)),
        ("SPDX-License-Identifier: MIT AND " * 30_000, (0, 30_000)),
        ("SPDX-License-Identifier:MIT " * 35_000, (35_000, 0)),
        ("SPDX-License-Identifier: " + "x" * 1_000_000, (0, 1)),
        ("SPDX-License-Identifier: " + " AND ".join(f"x{i}" for i in range(90_000)), (1, 0)),
        ("SPDX-License-Identifier: " + " OR ".join(f"x{i}" for i in range(90_000)), (1, 0)),
        ("SPDX-License-Identifier: " + "(" * 90_000 + "MIT" + ")" * 90_000, (1, 0)),
        ("license = '" * 90_000, (0, 0)),
        ("@license " * 100_000, (0, 0)),
    ],
)
def test_a_megabyte_of_tags_takes_time_and_memory_in_line(text, tags):
    m = op8._machine()
    start = time.time()
    r = op8.scan(m, text)
    assert time.time() - start < 4 and r[7:9] == tags and len(r[9]) < 4 * len(text)
    tracemalloc.start()
    op8._tags(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_identifiers_have_a_length():
    m = op8._machine()
    assert op8.scan(m, f"SPDX-License-Identifier: {'a' * 128}")[5:9] == ("a" * 128, 0.75, 1, 0)
    assert op8.scan(m, f"SPDX-License-Identifier: {'a' * 129}")[7:9] == (0, 1)
    assert op8.scan(m, f"SPDX-License-Identifier: MIT OR {'a' * 129}")[7:9] == (0, 1)
    assert op8.postfix("DocumentRef-x.1:LicenseRef-y OR MIT: see") == ["DocumentRef-x.1:LicenseRef-y", "MIT", "or"]
    assert op8.scan(m, "SPDX-License-Identifier:SPDX-License-Identifier: MIT")[5:9] == ("mit", 0.75, 1, 1)
    assert op8.scan(m, "SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC")[5:9] == ("isc", 0.75, 1, 1)


def random_expression(rnd, depth=0):
    if depth > 3 or rnd.random() < 0.3:
        name = rnd.choice(["MIT", "Apache-2.0", "GPL-2.0-only", "ISC", "0BSD", "LicenseRef-x"])
        return (f"{name} WITH exc-{rnd.randrange(3)}", [[f"{name} WITH exc"]]) if rnd.random() < 0.2 else (name, [[name]])
    (a, x), (b, y) = random_expression(rnd, depth + 1), random_expression(rnd, depth + 1)
    if rnd.random() < 0.5:
        return f"({a} OR {b})", x + y
    return f"({a} and {b})", [p + q for p in x for q in y]


def test_expressions_with_brackets_against_their_own_making():
    rnd = random.Random(6)
    some = 0
    for _ in range(300):
        text, made = random_expression(rnd)
        found = op8.choices(op8.postfix(text), 10**6, 10**9)
        assert {frozenset(re.sub(r"exc-\d", "exc", x) for x in c) for c in found} == {frozenset(c) for c in made}
        labels = {op8.family(x.split(" WITH ")[0]) for c in made for x in c}
        assert op8.licences(op8.postfix(text)) == labels
        some += len(made) > 2
    assert some > 60
