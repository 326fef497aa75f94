import re

import corpus_pipeline as pipeline
from data import frame
from test_op1 import brute as cut
from test_op5 import brute as groups
from test_op9_op10 import corpus
from vigilake.llm import op6_mixing as op6
from vigilake.llm import op9_toxicity as op9


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, tmp_path):
    docs, labels = corpus(400)
    rows = [(*d[:4], len(d[1])) for d in docs]
    rows += [(1000 + i, rows[i][1], "en", "t", None) for i in range(30)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    model = op9.train(frame(spark, rows), spark.read.parquet(f"{sf}/labels.parquet"))
    one = pipeline.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = sorted(map(tuple, one.collect()))
    assert kept == sorted(r for r in table if model.score(r[1] or "") < 0.5) and 300 < len(kept) < len(rows)

    two = pipeline.near_copies(spark, frame(spark, kept), sf)
    firsts = {i for i, _, c in groups(kept) if i == c}
    unique = sorted(map(tuple, two.collect()))
    assert unique == [r for r in kept if r[0] in firsts] and len(unique) < len(kept)

    three = sorted(map(tuple, pipeline.repeated_passages(spark, frame(spark, unique), sf).collect()))
    lost = {i: n for i, _, n, _ in cut(unique)}
    for old, new in zip(unique, three):
        assert (old[0], *old[2:4]) == (new[0], *new[2:4]) and len(words(new[1])) == len(words(old[1])) - lost[old[0]] and new[4] == len(new[1])
        assert lost[old[0]] or new[1] == (old[1] or "")

    taken = {r.doc_id: r.taken for r in op6.Mix(frame(spark, three)).taken().collect()}
    four = sorted(map(tuple, pipeline.mixing(spark, frame(spark, three), sf).collect()))
    assert [r[0] for r in four] == sorted(i for i, n in taken.items() if n)
    before = {r[0]: words(r[1]) for r in three}
    for r in four:
        assert len(words(r[1])) == taken[r[0]] and set(words(r[1])) <= set(before[r[0]])

    five = pipeline.packing(spark, frame(spark, four), sf).collect()
    assert {r.doc_id for r in five} == {r[0] for r in four}
    assert sum(r.length for r in five) == sum({r.doc_id: r.doc_tokens for r in five}.values())
    got = sorted(tuple(r) for r in pipeline.run(spark, sf).collect())
    assert got == sorted(map(tuple, five))
