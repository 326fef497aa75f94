import random
import zlib
from functools import reduce

import numpy as np
import pytest
from data import documents, frame
from pyspark.sql import functions as F
from vigilake.llm import op9_toxicity as op9
from vigilake.llm import op10_neighbours as op10


def corpus(n=1500):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(5, 80))
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Vile", "rotten,", "nastyish", "nastyest"]))
        docs.append((i, " ".join(words), "en", "s", None))
        if rnd.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        docs[-1] += (toxic,)
    return docs, labels


def test_learns_from_positives_and_unlabelled(spark):
    docs, labels = corpus()
    df = frame(spark, [d[:5] for d in docs])
    model = op9.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in op9.score(df, model).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]].held_out == (zlib.crc32(str(d[0]).encode()) % 5 == 0) for d in docs)
    right = sum((got[d[0]].score >= 0.5) == d[5] for d in held) / len(held)
    assert right > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    again = op9.score(df, op9.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({k: r.score for k, r in got.items()})


def test_toxicity_degenerate(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark, documents(10))
    assert op9.score(df, op9.train(df, none)).count() == len(documents(10))
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (0, 1, 1), (0, 1, 0), (6, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert op9.score(df, op9.train(df, odd)).count() == len(documents(10))
    empty = frame(spark, [], 1)
    assert op9.score(empty, op9.train(empty, odd)).count() == 0


def models(n_features, prior, left=(-1,), decay=0.0):
    shape = (n_features, len(left))
    return op9.Models(n_features, prior, np.full(shape, decay), np.ones(shape, bool), np.array(left))


def grouped(rows, positive, part=None, n=None):
    part = np.zeros(len(rows), np.int64) if part is None else np.array(part)
    return op9.chunks(np.array(positive, bool), part, [np.array(r, np.int32).tobytes() for r in rows], np.ones(len(rows), np.int64) if n is None else np.array(n))


def test_a_negative_part_of_the_risk_is_turned_back():
    rows = grouped([[0], [1], [0], []], [True, False, False, False], n=[5, 20, 2, 0])
    m = models(2, 2 / 22, decay=5e-4)
    m.fit(lambda w: m.sums(rows, w))
    w = m.weights[:, 0]
    assert w[0] + w[2] > 0 > w[1] + w[2]


def plain_parts(rows, positive, n, w, prior):
    f = np.array([sum(w[i] for i in r) + w[-1] for r in rows])
    p = np.array(positive)
    n = np.array(n, float)
    toward = prior * (n * np.log1p(np.exp(-f)))[p].sum() / n[p].sum()
    away = n * np.log1p(np.exp(f))
    return toward, away[~p].sum() / n[~p].sum() - prior * away[p].sum() / n[p].sum()


def test_gradient_as_by_small_steps():
    rnd = np.random.default_rng(3)
    rows = [np.flatnonzero(rnd.random(12) < 0.3) for _ in range(60)]
    positive, n = rnd.random(60) < 0.3, rnd.integers(1, 5, 60)
    for prior, bias, sign in ((0.05, 0.0, 1), (0.3, 0.0, 1), (0.9, -4.0, -1)):
        m = models(12, prior)
        w = np.append(rnd.normal(size=12) * 0.3, bias)
        if sign < 0:  # positives far above, unlabelled rows far below
            rows = [np.append(r[r < 11], [11] * int(p)).astype(int) for r, p in zip(rows, positive)]
            w[11] = 7.0
        parts = plain_parts(rows, positive, n, w, prior)
        sums = m.sums(grouped(rows, positive, n=n), w[:, None])
        assert np.allclose([x[0] for x in m.parts(sums)], parts) and (parts[1] >= 0) == (sign > 0)
        assert m.risk(sums)[0] == pytest.approx(parts[0] + max(0, parts[1]))
        turned = lambda v: (lambda t: t[0] + sign * t[1])(plain_parts(rows, positive, n, v, prior))
        small = [(turned(w + 1e-6 * e) - turned(w - 1e-6 * e)) / 2e-6 for e in np.eye(13)]
        assert np.abs(m.gradient(sums)[:, 0] - small).max() < 1e-5


def test_chunks_and_parts_left_out(monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [np.flatnonzero(rnd.random(9) < 0.2) for _ in range(200)]
    positive, part = rnd.random(200) < 0.2, rnd.integers(0, 3, 200)
    m = models(9, 0.2, (0, 1, 2, -1))
    w = rnd.normal(size=(10, 4))
    whole = m.sums(grouped(rows, positive, part), w)
    monkeypatch.setattr(op9, "_ENTRIES", 7)
    assert np.allclose(m.sums(grouped(rows, positive, part), w), whole)
    for i, left in enumerate((0, 1, 2, -1)):
        kept = [j for j in range(200) if part[j] != left]
        want = plain_parts([rows[j] for j in kept], positive[kept], np.ones(len(kept)), w[:, i], 0.2)
        assert np.allclose([x[i] for x in m.parts(whole)], want)
        if left >= 0:
            out = [j for j in range(200) if part[j] == left]
            want = plain_parts([rows[j] for j in out], positive[out], np.ones(len(out)), w[:, i], 0.2)
            assert np.allclose([x[i] for x in m.parts(whole, True)], want)


def test_the_setting_is_chosen_by_the_risk_left_out():
    # words 0..3 tell; prefixes 4..9 are noise that only memory can use
    rnd = np.random.default_rng(8)
    rows, positive = [], []
    for i in range(900):
        bad = i % 6 == 0
        rows.append(sorted({*([rnd.integers(0, 4)] if bad or rnd.random() < 0.02 else []), *(rnd.choice(np.arange(4, 60), 6).tolist())}))
        positive.append(bad and rnd.random() < 0.5)
    names = [b"=w%d" % i for i in range(4)] + [b"^p%d" % i for i in range(56)]
    m = op9.compared(names, 1 / 6)
    table = grouped(rows, positive, np.arange(900) // 6 % op9.PARTS)
    m.fit(lambda w: m.sums(table, w), 200)
    sums = m.sums(table)
    risks = np.where(m.left >= 0, m.risk(sums, True), 0).reshape(-1, op9.PARTS + 1).sum(axis=1)
    assert op9.choose(m, sums) == np.argmin(risks) and risks[1] < risks[0]
    few = grouped(rows[:12], positive[:12], np.arange(12) % op9.PARTS)
    assert op9.choose(m, m.sums(few)) == 0


def test_shards(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    rows = [(bool(rnd.random() < 0.2), int(rnd.integers(0, 3)), bytearray(np.flatnonzero(rnd.random(20) < 0.2).astype(np.int32).tobytes()), int(rnd.integers(1, 40))) for _ in range(400)]
    table = spark.createDataFrame(rows, "positive boolean, part int, at binary, n long").repartition(5)
    # each group's rows go to the shards in equal numbers
    back = {}
    for r in op9.dealt(table, 7).groupBy("part", "at").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("shares")).collect():
        back[r.part, bytes(r["at"])] = r.n
        assert r.most - r.least <= 1 or r.shares > 7  # groups that stand twice in the table add up
    want = {}
    for positive, part, at, n in rows:
        if not positive:
            want[part, bytes(at)] = want.get((part, bytes(at)), 0) + n
    assert back == want
    # one shard is the plain fit, several are near it
    monkeypatch.setattr(op9, "EPOCHS", 60)
    plain = models(20, 0.2, (0, 1, 2, -1), 1e-2)
    ordered = sorted(rows, key=lambda r: (r[0], r[1], bytes(r[2])))
    groups = op9.chunks(*(np.array(x) if i != 2 else [bytes(v) for v in x] for i, x in enumerate(zip(*ordered))))
    plain.fit(lambda w: plain.sums(groups, w), 60)
    one, many = models(20, 0.2, (0, 1, 2, -1), 1e-2), models(20, 0.2, (0, 1, 2, -1), 1e-2)
    sums = op9.fit_all(table, one)
    op9.fit_all(table, many, shard=500)
    assert np.allclose(one.weights, plain.weights) and np.allclose(sums, plain.sums(groups))
    assert np.corrcoef(many.weights.ravel(), plain.weights.ravel())[0, 1] > 0.95


def test_scores_as_by_hand(spark):
    docs, labels = corpus(600)
    rows = [d[:5] for d in docs] + [(9000, None, None, None, None), (9001, "", None, None, None), (None, "Vile! x", None, None, None), (9002, "vile " * 50_000, None, None, None), docs[0][:5]]
    df = frame(spark, rows)
    model = op9.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weight = dict(zip(model.names, model.weights.tolist()))
    assert weight
    want = []
    for doc_id, text, *_ in rows:
        have = set()
        for w in (text or "").lower().split():
            w = w.strip(".,;:!?\"'()[]{}<>-_*")
            have |= {"=" + w} | {"^" + w[:n] for n in (4, 5) if len(w) > n}
        z = model.bias + sum(v for x, v in weight.items() if x.decode() in have)
        want.append((doc_id, round(1 / (1 + np.exp(-z)), 9)))
    assert sorted(((r.doc_id, round(r.score, 9)) for r in op9.score(df, model).collect()), key=str) == sorted(want, key=str)


def test_bounds_of_the_sample_are_parameters(spark):
    docs, labels = corpus()
    df = frame(spark, [d[:5] for d in docs])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert op9.train(df, table, most_positive=3).names == []  # no feature can stand in five of them


def vectors():
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(i, rows[i % 50][1], 0) for i in range(400, 460)]  # ties
    rows += [(500, None, 0), (501, [0.0] * 8, 0), (502, [1.0, None] * 4, 0), (503, [float("nan")] * 8, 0), (504, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (520, [], 0)]
    return rows + [(540, [2.0] * 3, 0), (541, [1.0] * 3, 0), (3, rows[3][1], 0), (40, rows[40][1], 0), (40, rows[41][1], 0)]  # repeated rows and ids


@pytest.mark.parametrize("blocks", [(2048, 8192), (7, 50), (30, 5)])
def test_neighbours(spark, blocks):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(tuple(r) for r in op10.nearest(df, F.col("vec_id") % 20 == 0, 20, *blocks).collect())
    ok = [(i, np.array(v, np.float64)) for i, v, _ in vectors() if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for n, (q, a) in enumerate(ok):
        if q % 20 == 0:
            every = [(-float(reduce(lambda t, x: t + x, (x * y for x, y in zip(a, b)), 0.0)), c) for m, (c, b) in enumerate(ok) if m != n and len(b) == len(a)]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(every)[:20])]
    assert got == sorted(want)


def test_neighbours_of_nothing(spark):
    assert op10.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=(50, 16)), rnd.normal(size=(70, 16)) * 5
    qa, sa, _, ea = quantised_a = op10.quantise(a)
    qb, sb, nb, eb = op10.quantise(b)
    near = (qa.astype(int) @ qb.astype(int).T) * sa[:, None] * sb[None]
    bound = np.linalg.norm(a, axis=1)[:, None] * eb[None] + ea[:, None] * nb[None]
    assert (np.abs(a @ b.T - near) <= bound + 1e-12).all() and quantised_a[0].dtype == np.int8


def fair(a, b):
    """The score as the docstring has it."""
    from fractions import Fraction

    plain = 0.0
    with np.errstate(all="ignore"):
        for x, y in zip(a, b):
            plain = plain + np.float64(x) * np.float64(y)
    if np.isfinite(plain):
        return float(plain)
    whole = sum((Fraction(float(x)) * Fraction(float(y)) for x, y in zip(a, b)), Fraction(0))
    try:
        return float(whole)
    except OverflowError:
        return np.inf if whole > 0 else -np.inf


@pytest.mark.parametrize("kind", ["large", "tiny", "wide", "cancel"])
def test_any_magnitude(spark, kind):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(130, 6))
    if kind == "large":
        base *= 1e200
    elif kind == "tiny":
        base *= 1e-300
    elif kind == "wide":
        base *= 10.0 ** rnd.integers(-300, 300, size=(130, 1))
    else:
        base = np.sign(base) * 2.0**700
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(3)
    for blocks in ((2048, 8192), (4, 30)):
        got = sorted(tuple(r) for r in op10.nearest(df, F.col("vec_id") % 20 == 0, 20, *blocks).collect())
        want = []
        for q in range(0, 130, 20):
            every = sorted((-fair(base[q], base[c]), c) for c in range(130) if c != q)
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(every[:20])]
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], rel=1e-12)


def test_a_merge_holds_k_rows():
    import pyarrow as pa

    rows = [(q, 0, c, float(c * 7 % 101)) for q in (1, 2) for c in range(5_000)]
    batches = [pa.record_batch([pa.array(x) for x in zip(*rows[i : i + 700])], ["query_id", "twin", "vec_id", "score"]) for i in range(0, len(rows), 700)]
    got = [tuple(r.values()) for b in op10._merge(20)(iter(batches)) for r in b.to_pylist()]
    best = sorted(((-float(c * 7 % 101), c) for c in range(5_000)))[:20]
    assert got == [(q, i + 1, c, -s) for q in (1, 2) for i, (s, c) in enumerate(best)]
