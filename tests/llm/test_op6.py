import re
from collections import Counter

import numpy as np
from data import documents, frame
from vigilake.llm import op6_mixing as op6


def test_targets():
    assert op6.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert op6.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert op6.targets([0, 10], [5, 2]) == [0.0, 10.0]
    t = op6.targets([1, 2, 300, 0], [5, 2, 1, 5])
    assert t == [3.0, 6.0, 294.0, 0.0]


def test_permutation_and_shards():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(op6.permute(np.arange(n), n, "k")) == list(range(n))
    counts = np.array([500, 0, 37, 1200])
    rows = [op6.shard_counts(counts, i, 7, 250, 3) for i in range(7)]
    total = np.zeros(4, int)
    for mine, before in rows:
        assert (before == total).all()
        total += mine
    assert (total == counts).all() and [int(m.sum()) for m, _ in rows] == [250] * 6 + [237]


def test_mix(spark):
    rows = documents()
    mix = op6.Mix(frame(spark, rows))
    got = mix.taken().collect()
    assert len(got) == len(rows)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r)) for r in rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r) for r in rows if r[3] == s) for s in names]
    aims = op6.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, (s, t) in enumerate(zip(sizes, aims)):
        mine = [r for r in got if r.source_index == i]
        assert {r.source_size for r in mine} == {s} and all(abs(r.target - t) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= 2 * op6.BLOCK_WORDS
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    # the draws themselves, counted by hand
    n, times = mix.block_words, Counter((d.source_index, d.block) for d in mix.draws.collect())
    assert max(times.values()) <= 3
    for r in got:
        assert r.taken == sum(times[r.source_index, w // n] for w in range(r.begin, r.begin + r["size"]))
    again = op6.Mix(frame(spark, rows, 2)).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert op6.Mix(frame(spark, [], 1)).taken().count() == 0
    only = op6.Mix(frame(spark, [(1, None, None, None, None)], 1)).taken().collect()
    assert [(r.target, r.taken, r.source_size) for r in only] == [(0.0, 0, 0)]


def test_documents_hold_the_taken_words(spark):
    def text(i, n):
        return " ".join(f"d{i}w{j}" for j in range(n))

    # "hot" comes last by code point among the known sources and is far over its target
    rows = [(i, text(i, 64 * (1 + i % 30) + i % 7), "en", "hot", None) for i in range(60)]
    rows += [(100 + i, text(100 + i, 200), "en", "a", None) for i in range(90)] + [(200 + i, text(200 + i, 300), "en", "b", None) for i in range(60)]
    docs = frame(spark, rows)
    mix = op6.Mix(docs)
    placed = {r.doc_id: r for r in mix.taken().collect()}
    times = Counter((d.source_index, d.block) for d in mix.draws.collect())
    out = {r.doc_id: r.text.split() for r in op6.mix_documents(docs).collect()}
    cut = 0
    for doc_id, full, _, source, _ in rows:
        r, words = placed[doc_id], full.split()
        often = [times[r.source_index, (r.begin + w) // op6.BLOCK_WORDS] for w in range(len(words))]
        want = [w for turn in range(max(often)) for w, n in zip(words, often) if n > turn]
        assert out.get(doc_id, []) == want
        cut += source == "hot" and 0 < len(want) < len(words)
    assert cut > 10
    hot = [r for r in placed.values() if r.source_size > 50_000]
    assert sum(len(out.get(r.doc_id, [])) for r in hot) <= hot[0].target + 2 * op6.BLOCK_WORDS < hot[0].source_size / 2


def test_draws_at_every_size():
    counts = np.array([30, 0, 50, 20])
    got = np.array([op6._thin(counts, 40, i) for i in range(4000)])
    assert (got.sum(axis=1) == 40).all() and (got >= 0).all() and (got <= counts).all()
    assert np.abs(got.mean(axis=0) - counts * 0.4).max() < 0.2
    share = counts / 100
    assert np.abs(got.var(axis=0) - 40 * share * (1 - share) * 60 / 99).max() < 0.5
    # totals far above numpy's limit: shards still differ by chance, and fill up
    counts = np.array([10**9, 3 * 10**9, 7])
    firsts = []
    for seed in range(40):
        (a, none), (b, before) = (op6.shard_counts(counts, i, 2, 2 * 10**9 + 4, seed) for i in range(2))
        assert a.sum() == 2 * 10**9 + 4 and (a + b == counts).all() and (before == a).all() and not none.any()
        firsts.append(int(a[0]))
    assert 7000 < np.std(firsts) < 21000  # sqrt(2e9 * 1/4 * 3/4 * 1/2) = 13,693


def test_small_sources(spark):
    for n_words in (5, 40):
        rows = [(i, " ".join(f"d{i}w{j}" for j in range(n_words)), "en", f"s{i:03}", None) for i in range(600)]
        got = op6.Mix(frame(spark, rows)).taken().collect()
        assert len(got) == 600 and all(0 <= r.taken <= 3 * n_words for r in got)
        for w in range(3):  # sources of one weight: together near their targets, each within two blocks
            mine = [r for r in got if r.source_index % 3 == w]
            aim = sum(r.target for r in mine)
            assert abs(sum(r.taken for r in mine) - aim) < 0.05 * aim
            assert all(abs(r.taken - r.target) <= 2 * max(1, n_words // 8) for r in mine)


def test_the_same_at_any_number_of_partitions(spark):
    rows = documents(80)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "8", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(str(tuple(r)) for r in op6.Mix(frame(spark, rows, 3)).taken().select("doc_id", "size", "begin", "taken").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_words_of_mixed_texts_of_several_sources(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(30 + 41 * (i % 9))), "en", f"s{i % 5}", None) for i in range(150)] + [(7, "a b c", "en", "s1", None)] * 3
    taken = sum(r.taken for r in op6.Mix(frame(spark, rows)).taken().collect())
    out = op6.mix_documents(frame(spark, rows)).collect()
    assert sum(len(r.text.split()) for r in out) == taken and any(r.target < r.source_size for r in op6.Mix(frame(spark, rows)).taken().collect())
