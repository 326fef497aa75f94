"""Quality: held-out accuracy, the updates against a plain restatement, places against words."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from data import documents, frame
from pyspark.sql import functions as F
from vigilake.llm import op13_quality as op13

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in op13.op13_quality(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(labels[i], r) for i, r in scored.items() if i in labels and r.held_out]
    good, bad = [r.score for q, r in out if q == 1], [r.score for q, r in out if q == 0]
    assert len(good) > 700 and len(bad) > 100
    assert np.mean([s >= 0.7 for s in good]) > 0.995 and np.mean([s < 0.7 for s in bad]) > 0.95
    assert np.mean([g > b for g in good[::5] for b in bad]) > 0.99
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in scored.items())


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op13.train(docs, labels)
    turned = labels.withColumn("quality", F.when(op13.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = op13.train(docs.repartition(7).withColumn("lang", F.lit("x")).withColumn("turn", F.lit(1)), turned.unionByName(labels.limit(0)))
    assert np.array_equal(model.weights, other.weights) and model.bias == other.bias
    fewer = op13.train(docs, labels, most_labelled=50)
    assert not np.array_equal(model.weights, fewer.weights)


def words(text):
    return re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z\u0080-\U0010ffff0-9 \t-\r]+", text)


def test_places_follow_words():
    texts = ["of%%% the the&&& 12ab é!é", "", " \n ", "a", "the the the", "x y x y", ". , . ,", "of%%% the the&&& 12ab é!é"]
    at, bounds = op13.grams(pa.array(texts))
    rows = [at[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    known = {}
    for text, row in zip(texts, rows):
        w = words(text)
        again = [i > 0 and x[0].isalpha() and (x == w[i - 1] or i > 1 and x == w[i - 2]) for i, x in enumerate(w)]
        want = []
        for i, x in enumerate(w):
            want += [x] + ([(w[i - 1], x)] if i else []) + (["again"] if again[i] else [])
        assert len(want) == len(row)
        for name, place in zip(want, row):
            assert known.setdefault(name if name == "again" else (name,), place) == place
    assert len(set(known.values())) == len(known)


def test_the_leader_against_its_formulas():
    rng = np.random.default_rng(1)
    leader, z, n = op13.Leader(6, 0.3, 1.0, 0.05, 0.01), [0.0] * 7, [0.0] * 7
    for _ in range(60):
        at = np.sort(rng.choice(6, 3, replace=False))
        value, label = rng.random(3), int(rng.random() < 0.5)
        w = {}
        for i in [*at.tolist(), 6]:
            l1, l2 = (0.05, 0.01) if i < 6 else (0.0, 0.0)
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1.0 + n[i] ** 0.5) / 0.3 + l2)
        x = dict(zip(at.tolist(), value.tolist())) | {6: 1.0}
        p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - label) * x[i]
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
            n[i] += g * g
        assert leader.update(at, value, label) == pytest.approx(p)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_rare_places_stay_zero():
    leader = op13.Leader(4, l1=0.6)
    leader.update(np.array([1]), np.array([1.0]), 1)
    assert leader.model().weights.tolist() == [0, 0, 0, 0] and leader.model().bias > 0


def test_nulls_repeats_and_empty_tables(spark):
    rows = documents(80)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0)) for i, r in enumerate(rows[:60])] + [(0, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = op13.train(docs, labels)
    got = op13.score(docs, model).collect()
    assert len(got) == len(rows) and all(r.held_out for r in got if r.doc_id is None)
    empty = 1 / (1 + np.exp(-model.bias))
    assert all(r.score == pytest.approx(empty) for r in got if r.doc_id in (1000, 1001, 1002))
    kept = op13.keep_good(docs, model).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if r.predicted)
    none = op13.train(docs, labels.limit(0))
    assert {r.score for r in op13.score(docs, none).collect()} == {0.5}
    assert op13.score(docs.limit(0), op13.train(docs.limit(0), labels)).count() == 0
    one = op13.score(frame(spark, [(5, "word " * 400_000, "en", "s", None)]), model).collect()
    assert len(one) == 1


def test_scores_do_not_depend_on_neighbours():
    model = op13.Model(np.random.default_rng(2).normal(size=op13.BUCKETS).astype(np.float32), 0.1)
    texts = [f"w{i} v{i % 7} and so on {i}" for i in range(200)]
    whole = model.scores(pa.array(texts))
    assert [model.scores(pa.array([t]))[0] for t in texts] == whole.tolist()
