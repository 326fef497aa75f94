import random
import re

import numpy as np
import pytest
from data import documents, frame
from vigilake.llm import op5_ngram_join as op5
from vigilake.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), i if i is None or not s else find(i)) for i, s in sets), key=str)


def chains(seed=5):
    """Groups of near copies, copies of copies, reordered and short texts."""
    rnd = random.Random(seed)
    vocab = [f"x{i}" for i in range(300)]
    rows, doc = [], 0
    for _ in range(12):
        words = rnd.choices(vocab, k=rnd.choice([4, 5, 6, 8, 40, 90, 200]))
        for _ in range(rnd.randint(1, 9)):
            rows.append((doc, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words), "en", "s", None))
            doc += rnd.randint(1, 5)
            for _ in range(rnd.randint(0, 3)):
                words = list(words)
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                words = words[len(words) // 8 :] + words[: len(words) // 8]
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("chunk,pivot_from", [(1000, 64), (3, 2), (6, 64)])
def test_same_as_brute_force(spark, monkeypatch, chunk, pivot_from):
    monkeypatch.setattr(op5, "_PIVOT_FROM", pivot_from)
    for rows in (documents(), chains()):
        assert result(op5.jaccard_components(frame(spark, rows), chunk=chunk)) == brute(rows)


def test_empty(spark):
    assert op5.jaccard_components(frame(spark, [], 1)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_search_and_groups(seed):
    rnd = random.Random(seed)
    base = rnd.sample(range(1000), 60)
    sets = []
    for _ in range(40):
        s = set(base)
        for _ in range(rnd.choice([0, 2, 5, 9, 20, 60])):
            s.discard(rnd.choice(base))
            s.add(rnd.randrange(1000))
        sets.append(np.array(sorted(s), np.uint64))
    linked = [[100 * len({*a} & {*b}) >= 75 * len({*a} | {*b}) for b in sets] for a in sets]
    order = sorted(range(40), key=lambda i: len(sets[i]))
    index = op5.Index()
    for n, i in enumerate(order):
        assert sorted(index.search(sets[i].tolist())) == [m for m, j in enumerate(order[:n]) if linked[i][j]]
        index.add(sets[i].tolist())

    def parts(links):
        up = list(range(40))
        for a, b in links:
            a, b = op5._find(up, a), op5._find(up, b)
            up[a] = b
        return [op5._find(up, i) for i in range(40)]

    same = lambda p: {frozenset(i for i in range(40) if p[i] == x) for x in p}
    want = same(parts([(i, j) for i in range(40) for j in range(i) if linked[i][j]]))
    for pivot in (None, 0, 17):
        links, apart = op5.link_group(list(range(40)), sets, pivot, None)
        assert same(parts(links)) == want and all(linked[a][b] for a, b in links)
        if pivot is not None:
            assert set(apart) == set(range(40)) - next(x for x in want if pivot in x)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100, 300: 300, 301: 300}
