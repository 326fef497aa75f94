"""Every operator on extra columns with clashing names, repeated rows, nulls and a very long text."""

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest
from data import documents, frame
from pyspark.sql import functions as F
from test_op5 import brute
from vigilake.llm import op1_substring_dedup as op1
from vigilake.llm import op2_packing as op2
from vigilake.llm import op3_token_counts as op3
from vigilake.llm import op4_fingerprints as op4
from vigilake.llm import op5_ngram_join as op5
from vigilake.llm import op6_mixing as op6
from vigilake.llm import op7_warc as op7
from vigilake.llm import op8_license_scans as op8
from vigilake.llm import op9_toxicity as op9
from vigilake.llm import op10_neighbours as op10
from vigilake.llm import op11_periodic_runs as op11
from vigilake.llm import op12_fill_in_middle as op12
from vigilake.llm import op13_quality as op13
from vigilake.llm.common import Words, shared_folder

#: Names that operators use inside.
NAMES = list(dict.fromkeys((
    "h1 h2 text_h1 text_h2 digest twin parts key range copy own slot rank base begin block step source_index times component component_id node home chunk rep members n shingle bucket place spans "
    "is_first carried runs hot anchor canon tie sha start length ids sequence_id offset n_words labels score predicted held_out turn positive toxic at cell part is_query vector query_id runs collapsed best start period h0 h3 form output value quality c0 c1 c2 a.b"
).split()))
LONG = " ".join(f"long{i % 977}x{i % 1013}" for i in range(60_000))


def rows():
    return documents(40) + [(4000, LONG, "en", "s1", None), (4001, LONG + " end", "en", None, None), (4000, LONG, "en", "s1", None)]


def clashing(df):
    return df.select("*", *[(F.lit(f"extra {n}") if i % 2 else F.lit(None).cast("string")).alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


def model(spark):
    labels = spark.createDataFrame([(r[0], 1, int(i % 9 == 0)) for i, r in enumerate(documents(40)) if r[0] is not None], "doc_id long, quality int, toxic int")
    return op9.train(frame(spark, rows()), clashing(labels))


def quality_model(spark):
    labels = spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(documents(40)) if r[0] is not None], "doc_id long, quality int, toxic int")
    return op13.train(clashing(frame(spark, rows())), clashing(labels))


OPERATORS = {
    "op1": lambda d, s: op1.remove_repeats(d),
    "op2": lambda d, s: op2.pack(d).drop("ids"),
    "op3": lambda d, s: op3.token_counts(d),
    "op4": lambda d, s: op4.fingerprints(d),
    "op5": lambda d, s: op5.jaccard_components(d),
    "op6": lambda d, s: op6.Mix(d).taken(),
    "op8": lambda d, s: op8.license_scan(d),
    "op9": lambda d, s: op9.score(d, model(s)),
    "op11": lambda d, s: op11.find_runs(d, change=op11.made_periodic),
    "op12": lambda d, s: op12.fill_in_middle(d),
    "op13": lambda d, s: op13.score(d, quality_model(s)),
}


def result(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_are_ignored(spark, name):
    plain, more = frame(spark, rows()), clashing(frame(spark, rows()))
    got = OPERATORS[name](more, spark)
    want = OPERATORS[name](plain, spark)
    assert got.columns == want.columns and result(got) == result(want)
    assert OPERATORS[name](clashing(frame(spark, [], 1)), spark).count() == 0


def test_pages_and_vectors(spark, tmp_path):
    pages = [(i % 5, f"u{i}", "x" * (i % 3)) for i in range(12)] + [(None, None, None)] * 2 + [(90, "u", "é" * 400_000)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    back = [result(op7.read_archives(op7.normalise_archives(op7.write_archives(d, f"file://{tmp_path}/{i}"))).drop("path", "offset", "length")) for i, d in enumerate((df, clashing(df)))]
    assert back[0] == back[1] and len(back[0]) == len(pages)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(20, [3.0, 1.0]), (20, None)], "vec_id long, embedding array<double>")
    near = [result(op10.nearest(d, F.col("vec_id") % 20 == 0, 5)) for d in (vectors, clashing(vectors))]
    assert near[0] == near[1] and len(near[0]) == 4 * 5


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, tmp_path, stage):
    spark.createDataFrame([(r[0], 1, 0) for r in documents(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(pipeline.STAGES)[stage]
    plain, more = frame(spark, rows()), clashing(frame(spark, rows()))
    got, want = run(spark, more, str(tmp_path)), run(spark, plain, str(tmp_path))
    if stage != "packing":
        assert got.columns == more.columns
        extras = [n for n in NAMES if n not in plain.columns]
        assert all(r[n] in (None, f"extra {n}") and (r[n] is None) == (NAMES.index(n) % 2 == 0) for r in got.select(*[f"`{n}`" for n in extras]).collect() for n in extras)
        got = got.select(*plain.columns)
    assert result(got) == result(want)
    assert run(spark, clashing(frame(spark, [], 1)), str(tmp_path)).count() == 0


def test_words_made_to_collide(spark):
    def sign(n, a, b):
        return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))

    x, y = sign(2048, "a", "b"), sign(2048, "b", "a")  # equal under any polynomial modulo 2^64
    w = Words(pa.array([x, y, f"{x} {y} {x}"]))
    assert len(np.unique(w.hash)) == 2 and w.hash[2] == w.hash[0] == w.hash[4]
    some = [(1, f"{x} b c d e", "en", "s", None), (2, f"{y} b c d e", "en", "s", None), (3, f"{x} b c d e", "en", "s", None)]
    got = sorted(tuple(r) for r in op5.jaccard_components(frame(spark, some)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(some) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_a_home_of_many_classes_that_are_apart(spark):
    # one common passage and a last word of its own: three of four shingles are shared, no two link
    some = [(i, f"a b c d e f g w{i}", "en", "s", None) for i in range(400)] + [(1000 + i, f"a b c d e f g h i j k l m n o p q r s t u v x{i}", "en", "s", None) for i in range(300)]
    for chunk, shingles in ((1000, 10**6), (30, 10**6), (1000, 200)):
        got = sorted((tuple(r) for r in op5.jaccard_components(frame(spark, some), chunk=chunk, chunk_shingles=shingles).select("doc_id", "n_shingles", "component_id").collect()), key=str)
        assert got == brute(some)


def test_the_shared_folder():
    def session(master, folder=None):
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})})

    assert shared_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[8]")).startswith("file://")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
