"""Literals that a regular expression requires, and the numbered letter triples by which rules and texts meet.

required() reads a rule's parse tree: of what must be matched one after the other, the longest run of plain ASCII letters
and signs; of alternatives, one literal each. A text that holds none of them cannot be matched, so a rule is tried only on
texts that share a triple of each kind. Triples are hashed to PLACES numbers, so what is told to all tasks about the rules is
a bitmap of fixed size, however many rules there are.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from re import _constants as sre  # the parse tree has no public names
from re import _parser as parser

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
PLACES = 1 << 20
MOST_ALTERNATIVES = 8
#: Letters beyond ASCII that equal ASCII ones where case is ignored: Kelvin sign, dotted and dotless i, long s.
_ALSO = {"\u212a": "k", "\u0130": "i", "\u0131": "i", "\u017f": "s"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(_ALSO)
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(_ALSO.values())
_FOLD = str.maketrans(_UPPER, _LOWER)
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"  # letters by how often texts hold them


def fold(text: str) -> str:
    return text.translate(_FOLD)


def folded(text: Column) -> Column:
    """A text in which literals are looked up: ASCII letters, and what equals them, in lower case."""
    return F.translate(text, _UPPER, _LOWER)


@lru_cache(4096)
def compiled(rule: str | None) -> re.Pattern | None:
    """The rule as it is searched; none if it is empty or does not compile."""
    try:
        return re.compile(rule, re.I) if rule else None
    except (re.error, RecursionError, OverflowError):
        return None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, of each of which some literal must be met, the one whose shortest literal is longer."""
    rank = lambda s: (min(map(len, s)), -len(s), sorted(s)) if s else (0, 0, [])
    return max((a, b), key=rank)


def _of(items) -> frozenset[str] | None:
    best, run = None, []

    def end() -> None:
        nonlocal best
        if run:
            best = _better(best, frozenset(["".join(run)]))
            run.clear()

    def walk(items) -> None:
        nonlocal best
        for kind, value in items:
            if kind is sre.LITERAL and value < 128:
                run.append(fold(chr(value)))
            elif kind is sre.SUBPATTERN:
                walk(value[-1])
            elif kind is sre.AT:
                continue
            else:
                end()
                if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
                    best = _better(best, _of(value[2]))
                elif kind is sre.ATOMIC_GROUP:
                    best = _better(best, _of(value))
                elif kind is sre.BRANCH:
                    each = [_of(x) for x in value[1]]
                    if all(each) and len(frozenset().union(*each)) <= MOST_ALTERNATIVES:
                        best = _better(best, frozenset().union(*each))

    walk(items)
    end()
    return best


@lru_cache(4096)
def required(rule: str) -> frozenset[str] | None:
    """Literals, folded, one of which stands in every text that the rule matches; None if none is known."""
    if compiled(rule) is None:
        return None
    try:
        return _of(parser.parse(rule, re.I))
    except RecursionError:
        return None


def place(gram: str) -> int:
    return zlib.crc32(gram.encode()) % PLACES


def _rare(gram: str) -> int:
    return sum(_COMMON.find(c) if c in _COMMON else 30 for c in gram)


def key_places(rule: str | None) -> list[int] | None:
    """The places at which a rule is looked up: for each required literal its rarest triple. None: it must be tried on every text."""
    needed = required(rule) if rule else None
    if not needed or min(map(len, needed)) < GRAM:
        return None
    return sorted({place(max((x[i : i + GRAM] for i in range(len(x) - GRAM + 1)), key=lambda g: (_rare(g), g))) for x in needed})


def places_in(text: str, known: np.ndarray) -> list[int]:
    """The places of a folded text's triples that the bitmap knows."""
    return sorted({p for p in map(place, {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}) if known[p >> 3] >> (p & 7) & 1})


def bitmap(places: list[int]) -> np.ndarray:
    out = np.zeros(PLACES // 8, np.uint8)
    at = np.array(places, np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out
