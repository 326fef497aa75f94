"""Suffix automaton over words, grown online, with matching statistics."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """A generalised suffix automaton: several strands of words, no match crosses from one to another."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def new_strand(self) -> None:
        self.last = 0

    def extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(word)
        if q is not None:
            if length[q] != length[p] + 1:
                q = self._clone(p, q, word)
            self.last = q
            return
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        self.last = new

    def _clone(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def step(self, state: int, matched: int, word) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in the automaton, after one more word."""
        nxt = self.next
        while word not in nxt[state]:
            state = self.link[state]
            if state == -1:
                return 0, 0
            matched = self.length[state]
        return nxt[state][word], matched + 1

    def settle(self, state: int, matched: int) -> int:
        """The state of a match after extend(), which may have split it."""
        while state and self.length[self.link[state]] >= matched:
            state = self.link[state]
        return state


def matching_statistics(automaton: SuffixAutomaton, words: Sequence) -> list[int]:
    """For each word, the length of the longest run ending there that the automaton knows."""
    state = matched = 0
    out = []
    for word in words:
        state, matched = automaton.step(state, matched, word)
        out.append(matched)
    return out


def repeated_spans(automaton: SuffixAutomaton, words: Sequence, least: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by runs of `least` words that the automaton knew or that start earlier here.

    Streams the words and adds each right after it was matched, but for the inner words of repeated runs, so
    afterwards the automaton knows every run of up to `least` words.
    """
    state = matched = 0
    spans: list[tuple[int, int]] = []
    automaton.new_strand()
    added = -1  # the last word that is in the current strand
    extend, step = automaton.extend, automaton.step
    for i, word in enumerate(words):
        state, matched = step(state, matched, word)
        start = i - least + 1
        if matched >= least:
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
        else:
            if added < i - 1:
                added = start - 1
                automaton.new_strand()
            for j in range(added + 1, i + 1):
                extend(words[j])
            added = i
            state = automaton.settle(state, matched)
    return spans
