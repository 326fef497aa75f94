"""Stored tables, one-file documents, first sight and rounds of asking."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from vigilake.operators import agents, pages, reports, traffic
from vigilake.sources import document, keyed

SCHEMA = "k long, name string, v long"


def stored(table):
    return {r.k: (r.name, r.v) for r in table.read().collect()}


def test_changes_against_a_dictionary(spark, tmp_path):
    rnd = random.Random(1)
    want = {i: (f"n{i}", i) for i in range(300)}
    table = keyed.KeyedTable.create(spark.createDataFrame([(k, *v) for k, v in want.items()], SCHEMA), f"file://{tmp_path}/t", ["k"], 8)
    for step in range(3):
        rows = [(rnd.randrange(400), rnd.choice([None, f"s{step}"]), i) for i in range(40)]
        table.upsert(spark.createDataFrame(rows, SCHEMA), F.col("v"))
        for r in rows:  # the largest v comes last
            want[r[0]] = r[1:]
        changes = {rnd.randrange(500): rnd.choice([None, -1]) for _ in range(20)}
        table.update(spark.createDataFrame(list(changes.items()), "k long, v long"), ["v"])
        want |= {k: (want[k][0], want[k][1] if v is None else v) for k, v in changes.items() if k in want}
        assert stored(table) == want == stored(keyed.KeyedTable(spark, f"file://{tmp_path}/t"))
    old = keyed.KeyedTable(spark, f"file://{tmp_path}/t", 1)
    assert stored(old) == {i: (f"n{i}", i) for i in range(300)}
    table.remove_before(table.manifest["version"])
    assert stored(table) == want and table.versions() == [table.manifest["version"]]


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    table = keyed.KeyedTable.create(spark.range(1000).selectExpr("id as k", "'a' as name", "id as v"), f"file://{tmp_path}/t", ["k"], 32)
    before = dict(table.manifest["buckets"])
    rows = spark.createDataFrame([(5, "b", 1), (6, "b", 1)], SCHEMA)
    touched = {str(r.b) for r in rows.select(table.bucket().alias("b")).collect()}
    table.upsert(rows, F.col("v"))
    assert {b for b, f in table.manifest["buckets"].items() if before.get(b) != f} == touched and len(touched) <= 2
    table.upsert(rows.limit(0), F.col("v"))
    assert table.read().count() == 1000 and table.manifest["version"] == 2


def test_a_second_writer_and_a_writer_that_dies(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = keyed.KeyedTable.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), path, ["k"], 4)
    two = keyed.KeyedTable(spark, path)
    one.upsert(spark.createDataFrame([(2, "b", 1)], SCHEMA), F.col("v"))
    with pytest.raises(keyed.Conflict):
        two.upsert(spark.createDataFrame([(3, "c", 1)], SCHEMA), F.col("v"))
    assert stored(keyed.KeyedTable(spark, path)) == {1: ("a", 1), 2: ("b", 1)}
    two.upsert(spark.createDataFrame([(3, "c", 1)], SCHEMA), F.col("v"), tries=2)
    assert stored(keyed.KeyedTable(spark, path)) == {1: ("a", 1), 2: ("b", 1), 3: ("c", 1)}
    (tmp_path / "t" / "versions" / f"{two.manifest['version'] + 1:012d}").write_text("")  # a writer that died before its marker was filled
    again = keyed.KeyedTable(spark, path)
    assert len(stored(again)) == 3
    again.upsert(spark.createDataFrame([(4, "d", 1)], SCHEMA), F.col("v"))
    assert len(stored(keyed.KeyedTable(spark, path))) == 4
    boom = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("name"), F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        again.upsert(boom, F.lit(1))
    with pytest.raises(Exception, match="a row without k"):
        again.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA), F.col("v"))
    assert len(stored(keyed.KeyedTable(spark, path))) == 4


FINDING = "seq long, cwe string, severity string, title string, description string, file_path string, line_start int, confidence int, remediation string, func_name string, snippet string"


def test_a_report_is_one_file_that_parses(spark, tmp_path):
    rows = [(i, "CWE-89", "high", f't"{i}\n', "é\\", "a.py", i, 50, None, None, "x") for i in range(5000)]
    findings = spark.createDataFrame(rows, FINDING).repartition(7)
    path = f"{tmp_path}/out/report.json"
    (tmp_path / "out").mkdir()
    document.write_document(reports.json_export(findings, "seq", "1.0"), path)
    got = json.load(open(path))
    assert got["meta"]["total_findings"] == 5000 and [f["title"] for f in got["findings"]] == [r[3] for r in rows]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["report.json"]
    document.write_document(reports.json_export(findings.limit(0), "seq"), f"file://{path}")  # replaced
    assert json.load(open(path))["findings"] == []
    scan = reports.scan_report(findings.selectExpr("*", "'' as poc", "'true_positive' as verdict"), "seq", "job", {})
    document.write_document(scan, path)
    assert len(json.load(open(path))["findings"]["high"]) == 5000
    bad = reports.json_export(findings, "seq").withColumn("line", F.when(F.col("seq") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        document.write_document(bad, path)
    assert len(json.load(open(path))["findings"]["high"]) == 5000  # the document before stands
    document.write_document(reports.markdown_report(findings, "seq"), path)
    text = open(path).read()
    assert text.startswith("# Security Audit Report\n") and text.index("## #1 [HIGH]") < text.index("## #2 [HIGH]") < text.index("## #4999 [HIGH]") < text.index("## Summary")


def test_first_sight(spark):
    link = lambda *h: " ".join(f"https://{x}.a.com/x" for x in h)
    rows = [("a.com", 2, "u2", link("p", "q")), ("a.com", 1, "u1", link("p", "p")), ("a.com", 3, "u3", link("q", "P")), ("b.com", 1, "u", link("p")), ("a.com", 4, "u4", None), ("a.com", None, "u0", link("z"))]
    df = spark.createDataFrame(rows, "site string, seq long, url string, html string").repartition(3)
    got = {(r.site, r.seq, r.n, tuple(r.hosts)) for r in pages.first_sight(df).collect()}
    assert got == {("a.com", 1, 1, ("p.a.com",)), ("a.com", 2, 1, ("q.a.com",)), ("a.com", 3, 1, ("P.a.com",)), ("a.com", None, 1, ("z.a.com",))}
    known = spark.createDataFrame([("a.com", "q.a.com"), ("b.com", "P.a.com")], "site string, host string")
    assert {r.seq for r in pages.first_sight(df, known).collect()} == {1, 3, None}
    assert pages.first_sight(df.limit(0)).count() == 0


def test_first_sight_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (url, host) in enumerate([("u1", "p"), ("u2", "p"), ("u3", "q")]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"site": "a.com", "url": url, "html": f"https://{host}.a.com", "at": f"2024-01-01 00:0{i}:00"}))
        os.utime(tmp_path / "in" / f"{i}.json", (i + 1, i + 1))  # files are taken by their time
    source = spark.readStream.schema("site string, url string, html string, at timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    pages.first_sight_stream(source, "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted((r.url, r.host) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("u1", "p.a.com"), ("u3", "q.a.com")]


def test_rounds_stop_at_the_budget(spark):
    hooks = spark.createDataFrame([(f"h{i}", i, "pending", 0.1) for i in range(4)] + [("done", 9, "verified", 0.9)], "hook_id string, seq long, status string, confidence double")
    real, none = '{"finding": {"title": "t"}}', "nothing"
    answers = spark.createDataFrame([(1, "h0", real, 40), (1, "h1", none, 40), (1, "h2", real, 40), (2, "h1", '{"finding": null}', 5), (2, "h2", real, 5), (2, "h3", real, None)], "round int, hook_id string, raw string, cost long")
    state = lambda got: {r.hook_id: (r.status, r.confidence) for r in got[0].collect()}
    log = lambda got: [tuple(r) for r in got[1].orderBy("round").collect()]
    got = agents.audit_rounds(hooks, answers, 100)  # h3 is refused in round 1, all in round 2
    assert state(got) == {"h0": ("verified", 0.5), "h1": ("analyzing", 0.1), "h2": ("verified", 0.5), "h3": ("pending", 0.1), "done": ("verified", 0.9)}
    assert log(got) == [(1, 3, 1, 120), (2, 0, 2, 120)]
    got = agents.audit_rounds(hooks, answers, 10_000)
    assert state(got)["h1"] == ("verified", 0.0) and state(got)["h3"] == ("verified", 0.5) and log(got) == [(1, 4, 0, 120), (2, 2, 0, 125)]
    assert log(agents.audit_rounds(hooks.limit(0), answers, 5)) == [] and log(agents.audit_rounds(hooks, answers, 0)) == [(1, 0, 4, 0)]


def test_traffic_report_of_nothing(spark):
    empty = spark.createDataFrame([], "seq long, method string, path string, headers map<string,string>, status int, body string, cors string")
    assert [r.line for r in traffic.traffic_report(empty).orderBy("part", "seq", "n").collect()] == ["[TRAFFIC_DIFF] target: all", "  Signed-in requests: 0", "  Anonymous requests: 0", "", "  Differences: 0", "", "  Guides (0):"]
