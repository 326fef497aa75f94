"""License scans: Aho-Corasick over words finds notice phrases and identifier tags; expressions are evaluated.

Words are runs of a-z, 0-9 and anything above ASCII, after A-Z is lower-cased. The automaton runs over the words joined
by single spaces, so a phrase matches wherever its words stand consecutively. What follows a tag goes through a
shunting-yard parser for AND, OR, WITH and brackets. The expression ends where an identifier follows another one or a
character that no expression has, at the next tag at the latest; it must be whole there, else it is malformed and gives
no label. An identifier has at most 128 characters (a longer one is malformed), and a tag's own name is none. So each
character is read for one tag only. Two kinds of tags:
SPDX-License-Identifier, which may name any identifier, and the fields of manifests and comments ("license": "MIT",
license = 'MIT', @license MIT), which count only if every identifier is of a known family.

A whole expression is evaluated to its choices: OR adds choices, AND combines them, WITH joins an exception to an
identifier. Their number can double with every factor (30 factors `(A OR B)` make 10^9), so an expression of more than
MOST_CHOICES choices, or whose choices name more than MOST_NAMED identifiers in all, is kept as it stands, in postfix order,
which loses nothing; labels need only its identifiers and never depend on that.

score = 1 - 2 ** -(places of base phrases + other phrases + 2 * well-formed tags).

Nulls, ties: a null text is empty (n_words 0, no places, empty labels, score 0). Every row gives one row, rows that
repeat too. Texts of any length are scanned whole, in time linear in their length. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that the method adds, as words.
ADDED = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl", "common development and distribution license": "cddl",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "simplified bsd": "bsd", "isc license": "isc", "zlib license": "zlib",
    "boost software license": "bsl", "artistic license": "artistic", "python software foundation license": "psf", "this is free and unencumbered software": "unlicense",
    "creative commons": "cc", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0", "public domain dedication": "cc0",
}
TAG, FIELD = "spdx license identifier", "license"
MOST_CHOICES, MOST_NAMED = 64, 256
_TAG = re.compile(r"spdx-license-identifier:[ \t]*", re.I)
_FIELD = re.compile(r"""(?:@license[ \t]+|["']licen[sc]e["'][ \t]*:[ \t]*["']|\blicen[sc]e[ \t]*=[ \t]*["'])""", re.I)
_FAMILIES = ("apache", "agpl", "lgpl", "gpl", "mit", "bsd", "mpl", "epl", "eupl", "cddl", "isc", "zlib", "bsl", "artistic", "psf", "unlicense", "cc0", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by")
_TOKEN = re.compile(r"[ \t]*([()]|(?:DocumentRef-[A-Za-z0-9.-]{1,128}:)?[A-Za-z0-9][A-Za-z0-9.+-]{0,127}(?![A-Za-z0-9.+-]))")
_LONG = re.compile(r"[ \t]*[A-Za-z0-9]")
_RANK = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # all else is a space


def family(identifier: str) -> str:
    """The label of an identifier: its family's, or itself."""
    name = identifier.lower()
    return next((f for f in _FAMILIES if name == f or name.startswith(f + "-")), name.rstrip("+"))


def postfix(text: str, at: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard: identifiers and operators of the expression from `at` on, in postfix order. Raises ValueError if malformed."""
    out, held, operand = [], [], True
    end = len(text) if end is None else end
    while m := _TOKEN.match(text, at, end):
        token = m[1].rstrip(".")
        rank = _RANK.get(token.lower())
        if token == "(":
            if not operand:
                raise ValueError("a bracket after an identifier")
            held.append(token)
        elif token == ")":
            if operand:
                raise ValueError("an operator before a bracket")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # the bracket is the text's around the expression
            held.pop()
        elif rank:
            if operand:
                raise ValueError("an operator without its left side")
            while held and _RANK.get(held[-1], 0) >= rank:
                out.append(held.pop())
            held.append(token.lower())
            operand = True
        elif not operand:
            break  # a word of the text after the expression
        else:
            out.append(token)
            operand = False
        at = m.end()
    if operand or "(" in held:
        raise ValueError("an identifier is too long" if _LONG.match(text, at, end) else "the expression is not complete")
    return out + held[::-1]


def licences(tokens: list[str]) -> set[str]:
    """The labels of an expression's identifiers, without those of exceptions."""
    out, stack = set(), []
    for token in tokens:
        if token not in _RANK:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left is None or right is None:
                raise ValueError("WITH joins one identifier and one exception")
            out.add(family(left))
        else:
            out |= {family(x) for x in (left, right) if x is not None}
        stack.append(None)  # known already
    return out | {family(x) for x in stack if x is not None}


def choices(tokens: list[str], most: int = MOST_CHOICES, named: int = MOST_NAMED) -> set[frozenset[str]] | None:
    """Sets of licences of which any one suffices; None if there are more than `most` of them on the way, or `named` identifiers in them."""
    stack: list[set[frozenset[str]]] = []
    if len(tokens) > 2 * most + named:
        return None
    for token in tokens:
        if token not in _RANK:
            stack.append({frozenset([token])})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            (one,), (exception,) = next(iter(left)), next(iter(right))
            stack.append({frozenset([f"{one} WITH {exception}"])})
            continue
        if len(left) * len(right) > most and token == "and" or len(left) + len(right) > most:
            return None
        stack.append(left | right if token == "or" else {a | b for a in left for b in right})
        if sum(map(len, stack[-1])) > named:
            return None
    return stack[0]


def told(tokens: list[str]) -> str:
    """Choices as text, in order; the postfix form if they are too many."""
    found = choices(tokens)
    return " ".join(tokens) if found is None else " OR ".join(sorted(" AND ".join(sorted(c)) for c in found))


def _machine():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in (*BASE, *ADDED, TAG, FIELD, "licence"):
        machine.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    machine.make_automaton()
    return machine


def _tags(text: str) -> tuple[list[list[str]], int]:
    """Well-formed expressions of tags in a text, and the number of malformed ones."""
    good, bad = [], 0
    tags = list(_TAG.finditer(text))
    for m, end in zip(tags, [m.start() for m in tags[1:]] + [len(text)]):
        try:
            tokens = postfix(text, m.end(), end)
            licences(tokens)
            good.append(tokens)
        except ValueError:
            bad += 1
    for m in _FIELD.finditer(text):
        try:
            tokens = postfix(text, m.end())
            good += [tokens] if licences(tokens) <= set(_FAMILIES) else []
        except ValueError:
            pass
    return good, bad


def scan(machine, text: str) -> tuple:
    words = text.encode().translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    places, base, labels, n_added, tagged = [], set(), set(), 0, False
    at = before = 0
    for end, (phrase, length) in machine.iter(joined):
        before += joined.count(" ", at, end)  # the words before this end
        at = end
        if phrase in BASE:
            places.append(before - length)
            base.add(BASE[phrase])
        elif phrase in ADDED:
            labels.add(ADDED[phrase])
            n_added += 1
        else:
            tagged = True
    good, n_bad = _tags(text) if tagged else ([], 0)
    for tokens in good:
        labels |= licences(tokens)
    strength = len(places) + n_added + 2 * len(good)
    first, last = (min(places), max(places)) if places else (None, None)
    score = 1.0 - 0.5**strength if strength < 60 else 1.0
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, len(good), n_bad, "; ".join(told(t) for t in good)


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_tags", pa.int64()), ("n_bad_tags", pa.int64()), ("choices", pa.string())]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = _machine()
    for batch in batches:
        for part in slices(batch):
            columns = zip(*(scan(machine, text) for text in part.column("text").to_pylist()))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, _OUT))], ["doc_id", *(n for n, _ in _OUT)])


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): one row for each row, no shuffle."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, n_bad_tags long, choices string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_emit, schema)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
