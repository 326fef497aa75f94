"""Streams whose rows arrive out of order against the batch tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from vigilake.operators import store
from vigilake.streaming import log

SCHEMA = "owner string, seq long, action string, entity string, ts string, cost long, at timestamp"


def events(n=120):
    rnd = random.Random(4)
    out = [(f"o{i % 3}", i // 2, rnd.choice(["act", "see", None]), rnd.choice([None, "e"]), f"t{i}", rnd.choice([None, 10, 7]), f"2024-01-01 00:{i // 2 // 60:02d}:{i // 2 % 60:02d}") for i in range(n)]
    return out + [("o0", 50, "act", None, "same", 3, "2024-01-01 00:00:50"), ("o0", 50, "act", None, "other", 4, "2024-01-01 00:00:50")] + out[40:43]  # rows that repeat


def test_rows_out_of_order_give_the_batch_chain(spark, tmp_path):
    log.use_state_store(spark)
    (tmp_path / "in").mkdir()
    rows = sorted(events(), key=lambda r: r[-1])
    rnd = random.Random(5)
    for i in range(0, len(rows), 30):  # shuffled inside windows that the delay covers
        part = rows[i : i + 30]
        rnd.shuffle(part)
        rows[i : i + 30] = part
    end = [("end", 0, None, None, None, None, "2024-01-02 00:00:00")]
    files = [rows[i : i + 11] for i in range(0, len(rows), 11)] + [end, end]
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for half in (files[: len(files) // 2], files[len(files) // 2 :]):  # the queries stop and start again in between
        for part in half:
            n = len(list((tmp_path / "in").iterdir()))
            (tmp_path / "in" / f"{n:04d}.json").write_text("\n".join(json.dumps(dict(zip((c.split()[0] for c in SCHEMA.split(", ")), r))) for r in part))
            os.utime(tmp_path / "in" / f"{n:04d}.json", (n + 1, n + 1))  # files are taken by their time
        for name, made in (("chain", log.chained(source(), "1 minute")), ("budget", log.budget(source(), 100, delay="1 minute"))):
            made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
    df = spark.createDataFrame([(*r[:-1], None) for r in events()], SCHEMA)
    want = store.hash_chain(df, "owner")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/chain").where("owner <> 'end'").select("owner", "seq", "hash").collect()) == sorted(map(tuple, want.collect()))
    gate = store.budget_gate(df.withColumn("d", store.event_digest("cost")), "owner", "seq", F.col("cost"), 100)
    got = spark.read.parquet(f"{tmp_path}/budget").where("owner <> 'end'")
    assert got.count() == len(events()) and got.agg(F.sum("cost")).first()[0] == sum(r[5] or 0 for r in events())
    by_seq = lambda d: sorted(tuple(r) for r in d.groupBy("owner", "seq").agg(F.min("spent_before"), F.min("refused")).collect())
    assert by_seq(got) == by_seq(gate)


def test_state_starts_from_a_table(spark, tmp_path):
    log.use_state_store(spark)
    (tmp_path / "in").mkdir()
    rows = events()
    old, new = [r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20] + [("end", 0, None, None, None, None, "2024-01-02 00:00:00")]
    for i, part in enumerate((new, new[-1:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip((c.split()[0] for c in SCHEMA.split(", ")), r))) for r in part))
        os.utime(tmp_path / "in" / f"{i}.json", (i + 1, i + 1))
    frame = lambda x: spark.createDataFrame([(*r[:-1], None) for r in x], SCHEMA)
    ends = store.chain_ends(store.hash_chain(frame(old), "owner"), "owner").select("owner", F.col("n_events").alias("place"), F.col("last_hash").alias("last"))
    made = log.chained(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), "1 minute", ends)
    made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {(r.owner, r.hash) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.owner, r.hash) for r in store.hash_chain(frame(rows), "owner").where("seq >= 20").collect()}
    assert want <= got


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_the_order_of_input_does_not_matter(spark, parts):
    rows = [(*r[:-1], None) for r in events()] + [(None, 1, "a", None, "t", 1, None), (None, 1, "b", None, "t", 1, None)]
    random.Random(parts).shuffle(rows)
    chain = store.hash_chain(spark.createDataFrame(rows, SCHEMA).repartition(parts), "owner", ["action", "entity", "ts"])
    ordered = store.hash_chain(spark.createDataFrame(sorted(rows, key=str), SCHEMA), "owner", ["action", "entity", "ts"])
    assert sorted(map(str, chain.collect())) == sorted(map(str, ordered.collect()))
    assert store.broken_links(chain, "owner").count() == 0
    wrong = chain.withColumn("hash", F.when(F.col("action") == "b", F.lit("x")).otherwise(F.col("hash")))
    assert [(r.owner, r.action) for r in store.broken_links(wrong, "owner").collect()] == [(None, "b")] and store.broken_links(wrong, "owner").columns == wrong.columns
