"""Places and running sums against plain loops, over many ranges."""

import random

import pytest
from pyspark.sql import functions as F
from vigilake.operators import order, store


def rows(n=3000):
    rnd = random.Random(2)
    out = [(rnd.choice([None, "a", "b", "c", "c", "c"]), rnd.choice([None, 1, 1, 1, 2, i]), rnd.choice([None, 3, i]), i) for i in range(n)]
    return out + out[:40]


SCHEMA = "g string, at long, v long, i long"
last = lambda x: (x is None, x or 0)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_groups_ties_and_nulls(spark, partitions):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
        got = order.numbered(order.running_sum(df, "at", F.col("v"), "before", ["g"], ["i"]), "at", "p", ["g"], ["i", "before"]).collect()
        whole = order.numbered(order.running_sum(df, ["at", "g"], F.col("v") / 2, "half", ties=["i"]), ["at", "g"], "place", ties=["i", "half"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = []
    for g in {r[0] for r in rows()}:
        total = 0
        for p, r in enumerate(sorted((r for r in rows() if r[0] == g), key=lambda r: (last(r[1]), r[3])), 1):
            want.append((*r, total, p))
            total += r[2] or 0
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    total, want = 0, []
    for p, r in enumerate(sorted(rows(), key=lambda r: (last(r[1]), r[0] is None, r[0] or "", r[3])), 1):
        want.append((*r, total / 2, p))
        total += r[2] or 0
    assert sorted((tuple(r) for r in whole), key=str) == sorted(want, key=str)


def test_a_constant_order_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("at"), F.col("id").alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
        seen = []
        kept = order.settle
        order.settle = lambda d, name: (seen.append(kept(d, name)), seen[-1])[1]
        try:
            out = order.numbered(df, "at")
        finally:
            order.settle = kept
        assert sorted(r.place for r in out.select("place").collect()) == list(range(1, 40_001))
        sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
        plan = store.budget_gate(df, None, "at", F.col("v"), 10)._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_group_or_none(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert order.numbered(df.limit(0), "at").count() == 0
    text = order.numbered(df.withColumn("t", F.concat(F.lit("x"), F.lpad(F.col("i").cast("string"), 5, "0"))), "t", "n").where("i = 2999").collect()
    assert [r.n for r in text] == [3040]
