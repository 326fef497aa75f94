import json
import time

import pytest
from pyspark.sql import functions as F
from vigilake.operators import agents, claims, encryption, hooks, knowledge, order, reports, store, traffic
from vigilake.sources import trees
from vigilake.streaming import index, log


def test_decisions_of_known_cases(spark):
    rows = [
        ("python", "demo/app.py", "get_user", "CWE-89", "high", "cur.execute(q)", "cur.execute(q)", True),
        ("python", "demo/app.py", "login", "CWE-89", "high", 'q = f"{u}"\ncur.execute(q)', "u = request.args", False),
        ("python", "demo/s.py", "login", "CWE-502", "high", "pickle.loads(x)", "", False),
        ("python", "tests/x/s.py", "login", "CWE-502", "high", "pickle.loads(x)", "", True),
        ("javascript", "demo/s.js", "exec", "CWE-78", "high", "exec(cmd)", "req.query", True),
        ("javascript", "demo/s.js", "require", "CWE-913", "medium", "require('x')", "req.query", False),
        (None, None, None, None, None, None, None, True),
    ]
    df = spark.createDataFrame(rows, "language string, path string, func string, cwe string, severity string, snippet string, content string, want boolean")
    got = hooks.decide(df).withColumn("c", hooks.confidence(F.col("fp_filtered"), F.col("severity"), F.col("snippet"))).collect()
    assert [r.fp_filtered for r in got] == [r[-1] for r in rows]
    assert got[2].c == 60 and got[5].c == 50


def test_lists_of_hooks(spark):
    df = spark.createDataFrame([("a", "pending", "high", "x"), ("b", "pending", "low", "x"), ("c", "verified", "high", "y")], "hook_id string, status string, severity string, hook_type string")
    ids = lambda d: [r.hook_id for r in d.collect()]
    assert ids(hooks.chosen(df, status="pending", hook_type="x")) == ["a", "b"] and ids(hooks.chosen(df)) == ["a", "b", "c"] and ids(hooks.chosen(df, severity="high", status="verified")) == ["c"]
    assert ids(hooks.pending(df)) == ["a", "b"] and ids(hooks.pending(df, 1)) == ["a"]
    assert ids(store.listed(df, newest="hook_id")) == ["c", "b", "a"] and ids(store.listed(df, status=None, severity="low")) == ["b"]


def test_chain_notices_changes(spark):
    rows = [(1, i, "act", None, f"2024-01-0{i + 1}") for i in range(5)] + [(2, 0, "x", "e", "t")]
    schema = "owner long, seq long, action string, entity string, ts string"
    last = lambda r: {x.owner: x.last_hash for x in store.chain_ends(store.hash_chain(spark.createDataFrame(r, schema), "owner"), "owner").collect()}
    base = last(rows)
    assert base == last(rows[::-1]) and base[1] != last(rows[1:])[1] and base[1] != last([*rows[:2], (1, 2, "other", None, rows[2][4]), *rows[3:]])[1]
    stored = spark.createDataFrame(rows, schema).join(store.hash_chain(spark.createDataFrame(rows, schema), "owner"), ["owner", "seq"])
    assert store.broken_links(stored, "owner").count() == 0
    forged = stored.withColumn("action", F.when(F.col("seq") == 2, "forged").otherwise(F.col("action")))
    assert sorted(r.seq for r in store.broken_links(forged, "owner").collect()) == [2, 3, 4]
    assert store.hash_chain(spark.createDataFrame([], schema), "owner").count() == 0


def test_updates_never_double_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "id long, status string, n int")
    changes = spark.createDataFrame([(1, "x", 5, 1), (1, "y", None, 2), (3, "z", 1, 3), (None, "w", 1, 4)], "id long, status string, n int, at long")
    got = sorted((tuple(r) for r in store.update(rows, changes, ["id"], ["status", "n"], seq="at").collect()), key=str)
    assert got == [(1, "y", 5), (2, "b", 0), (None, "c", 0)]
    table = spark.createDataFrame([(7, "p")], "id long, name string")
    assert sorted(tuple(r) for r in store.append(table, spark.createDataFrame([(30, "r"), (20, "q")], "at long, name string"), "at").collect()) == [(7, "p"), (8, "q"), (9, "r")]
    assert [tuple(r) for r in store.append(table.limit(0), spark.createDataFrame([(30, "r")], "at long, name string"), "at").collect()] == [(1, "r")]


@pytest.mark.parametrize("a,b,want", [("", "x", 0.0), (None, "x", 0.0), ("a" * 100, "a" * 100, 1.0), ("a" * 50 + "b" * 50, "a" * 50 + "c" * 50, 1 / 3), ('{"b":1,"a":2}', '{"a": 2, "b": 1}', 1.0)])
def test_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(traffic.similarity(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(want)


def test_sources(spark, tmp_path):
    files = {"src/a.py": b"x = 1", "src/b.min.js": b"y", "build/c.py": b"z", "d.txt": b"t", "e.PHP": b"<?php", "f.go": b"\xff\xfe bad", "g.py": b"#" * 600_000}
    for name, text in files.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(text)
    tree = trees.source_tree(spark, str(tmp_path / "t"))
    assert {r.path: (r.language, r.content) for r in tree.collect()} == {"src/a.py": ("python", "x = 1"), "e.PHP": ("php", "<?php"), "f.go": ("go", "�� bad")}
    assert {r.path for r in trees.whole_tree(spark, str(tmp_path / "t")).collect()} == set(files) - {"d.txt"}
    assert [r.line for r in trees.file_list(tree, 2).collect()] == ["  e.PHP (5 bytes)", "  f.go (6 bytes)"]
    assert trees.php_bytes(spark, str(tmp_path / "t")).first().path == "e.PHP"
    entry = {"request": {"method": "GET", "url": "https://h.example:8/p?q=1", "headers": [{"name": "A", "value": "1"}, {"name": "A", "value": "2"}]}, "response": {"status": 200, "content": {"size": 5}}}
    (tmp_path / "x.har").write_text(json.dumps({"log": {"entries": [entry]}}))
    r = trees.har(spark, str(tmp_path / "x.har"), "h.example").first()
    assert (r.path, r.headers, r.status) == ("/p?q=1", {"A": "2"}, 200)
    message = {"request": {"url": "https://h.example:8/p?q=1", "headers": [{"name": "Cookie", "value": "1"}]}, "response": {"status": 200, "body": "b"}}
    (tmp_path / "proxy.json").write_text(json.dumps({"messages": [message, {"request": {"url": "http://else/"}}, message, {}]}))
    got = [(r.seq, r.method, r.host, r.path, r.headers, r.status, r.response_body) for r in trees.proxy_export(spark, str(tmp_path / "proxy.json"), "h.example", 1).collect()]
    assert got == [(0, "GET", "h.example:8", "/p", {"Cookie": "1"}, 200, "b")] and trees.proxy_export(spark, str(tmp_path / "proxy.json")).count() == 4
    row = {"check_id": "a.b.c", "path": "p", "start": {"line": 1}, "end": {"line": 2}, "extra": {"severity": "ERROR", "lines": "l"}}
    (tmp_path / "s.json").write_text(json.dumps({"results": [row, row]}))
    s = trees.sast_report(spark, str(tmp_path / "s.json")).collect()
    assert len(s) == 1 and (s[0].func_name, s[0].severity, s[0].language, s[0].confidence, s[0].status) == ("c", "high", "python", 30.0, "pending") and json.loads(s[0].metadata)["check_id"] == "a.b.c"


def test_reports_are_whole_files(spark, tmp_path):
    rows = [(i, ["high", None, "info", "odd"][i % 4], "CWE-89", f"t{i}", 'say "x"\n', i, None, "a.py", 1, "f", "x", "", "true_positive") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, severity string, cwe string, title string, description string, confidence int, remediation string, file_path string, line_start int, func_name string, snippet string, poc string, verdict string")

    def text(lines, name):
        reports.write_lines(lines, f"file://{tmp_path}/{name}")
        return "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / name).glob("part-*")) if p.stat().st_size)

    whole = json.loads(text(reports.json_export(df, "seq"), "a"))
    assert whole["meta"]["total_findings"] == 20 and [f["title"] for f in whole["findings"]] == [f"t{i}" for i in range(20)] and whole["findings"][0]["description"] == 'say "x"\n'
    scan = json.loads(text(reports.scan_report(df, "seq", "j", {}), "b"))
    assert scan["stats"]["total_findings"] == 20 and scan["findings_by_severity"] == {"critical": 0, "high": 5, "medium": 0, "low": 0, "info": 10} and [f["title"] for f in scan["findings"]["high"]] == ["t0", "t4", "t8", "t12", "t16"]
    none = json.loads(text(reports.json_export(df.limit(0), "seq"), "c"))
    assert none["findings"] == [] and json.loads(text(reports.scan_report(df.limit(0), "seq", "j", {}), "d"))["stats"]["true_positives"] == 0
    marks = text(reports.markdown_report(df, "seq"), "e")
    assert marks.startswith("# Security Audit Report") and marks.endswith("- CWE-89: 20") and marks.index("## #5 [HIGH]") < marks.index("## #6 [MEDIUM]")
    (tmp_path / "r").mkdir()
    for i, name in enumerate("ab"):
        (tmp_path / "r" / f"{name}.json").write_text(json.dumps({"report_id": name, "stats": {"total_findings": i}}))
        time.sleep(1.1)
    assert [(r.report_id, r.total) for r in reports.report_list(spark, f"{tmp_path}/r").collect()] == [("b", 1), ("a", 0)]
    assert df.select(reports.file_name(F.lit("a/b: c_d-é!" + "x" * 60)).alias("n")).first().n == "ab c_d-é" + "x" * 32 + ".md"


def test_answers_of_agents(spark):
    raw = spark.createDataFrame([(1, '```json\n{"hooks": [{"file_path": "a.py", "function_name": "f", "hook_type": "injection", "risk_reason": "r"}, {}]}\n```'), (2, "none")], "id long, raw string")
    got = [(r.id, r.file_path, r.func_name, r.hook_type, r.language, r.severity, r.status) for r in agents.proposed_hooks(raw).collect()]
    assert got == [(1, "a.py", "f", "injection", "python", "high", "pending"), (1, "", "unknown", "unknown", "unknown", "high", "pending")]
    texts = [("[1, 2]", "[1, 2]"), ("x [1] y", "[1]"), ("{\"a\": 1} tail", '{"a": 1}'), ("```\n{}\n```", "{}"), ("{", None)]
    df = spark.createDataFrame(texts, "raw string, want string")
    assert all(r.got == r.want for r in df.select("want", agents.lenient_json(F.col("raw")).alias("got")).collect())
    meta = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("x",), (None,)], "m string").select(agents.metadata(F.col("m")).alias("m")).collect()
    assert [r.m for r in meta] == ['{"a": 1}', "{}", "{}", "{}"]
    hook = spark.createDataFrame([("h", "a.py", 3, 4, '{"description": "why"}', None, "own"), ("i", "gone.py", 1, 1, "bad", "risk", ""), ("j", None, 1, 1, None, None, None)], "hook_id string, path string, line_start int, line_end int, metadata string, risk_reason string, snippet string")
    chunk = spark.createDataFrame([("i", 7, 9, "code")], "hook_id string, line_start int, line_end int, snippet string")
    near = spark.createDataFrame([("h", 2, "two"), ("h", 1, "one")], "hook_id string, place int, text string")
    files = spark.createDataFrame([("a.py", "whole file")], "path string, content string")
    asked = {r.hook_id: tuple(r)[1:] for r in agents.audit_context(hook, chunk, near, files).collect()}
    assert asked == {"h": (3, 4, "why", "whole file", "one\n\ntwo"), "i": (7, 9, "risk", "code", "(no additional context available)"), "j": (1, 1, "Suspicious call detected", "(unable to extract code)", "(no additional context available)")}
    told = agents.class_reference().split("\n")
    assert told[0] == "## 18 classes of weaknesses" and len(told) == 2 + 3 * 18 and told[8:11] == ["- CWE-89: Query text built from input", "  Look for: SQL joined from strings; values formatted into a statement", "  What helps: bind values as parameters"]
    finding = {n: F.lit(None).cast("string") for n in ("id", "title", "severity", "cwe", "confidence", "description", "path", "func", "language")} | {"title": F.lit("T")}
    assert "## Charge: T\n" in hook.select(agents.charge(finding, F.col("snippet")).alias("c")).first().c


def test_patterns_are_described(spark):
    rows = [(i, "CWE-89" if i % 2 else "CWE-78", None, "cursor execute", "execute" if i % 3 else "(", i % 4, [float(i % 5), 1.0]) for i in range(23)]
    patterns = spark.createDataFrame(rows, "pid long, cwe_id string, code_signature string, vulnerable_snippet string, detection_rule string, seen long, v array<double>")
    snippets = spark.createDataFrame([(1, "cursor.execute(x)", "injection", [3.0, 1.0]), (2, None, None, None), (3, "plain words only", "injection", [0.0, 0.0])], "id long, snippet string, hook_type string, v array<double>")
    found = knowledge.retrieve(snippets, patterns)
    assert [r.pid for r in found.where("id = 1").orderBy("rank").collect()] == [7, 11, 19] and found.count() == 6
    assert knowledge.retrieve(snippets, patterns.limit(0)).count() == 0
    told = knowledge.described(found, patterns.withColumns({"pattern_type": F.lit("t"), "fix_snippet": F.lit("")})).collect()
    assert all(r.text.startswith("### Pattern 1: t (CWE-") for r in told)


def test_index_and_encryption(spark):
    files = spark.createDataFrame([("a/x.py", "import os\nname = 1\ndef go(arg): pass\n"), ("b.go", None)], "path string, content string")
    assert {r.name for r in claims.file_names(files).collect()} == {"x.py", "a/x.py", "b.go"} and [r.name for r in claims.declared_names(files).collect()] == ["go"]
    row = claims.project_index(files).first()
    assert row.imports == ["os"] and set(row.variables) == {"name", "arg", "os"}  # a word before a name counts, line ends or not
    php = spark.createDataFrame([("p", f"{i}.php", bytearray(b"\xff ionCube" if i < 3 else b"<?php\nionCube")) for i in range(10)] + [("q", "a.txt", bytearray(b"ionCube")), ("r", "a.php", None)], "project string, path string, content binary")
    got = {r.project: (r.total_files, r.encrypted_files, r.ratio, r.kind, r.verdict, r.samples) for r in encryption.encryption_report(php).collect()}
    assert got == {"p": (10, 3, 0.3, "ionCube", "skip", "0.php,1.php,2.php"), "q": (0, 0, 0.0, "none", "safe", ""), "r": (1, 0, 0.0, "none", "safe", "")}


def test_the_index_follows_files(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("import os\n")
    (root / "b.py").write_text("import re\n")
    tree = trees.whole_tree(spark, str(root))
    schema = "path string, modified timestamp, variables array<string>, imports array<string>"
    first = spark.createDataFrame(index.refresh(spark.createDataFrame([], schema), tree).collect(), schema)
    assert index.changed(tree, first).count() == 0
    time.sleep(1.1)
    (root / "b.py").write_text("import json\n")
    (root / "c.js").write_text("require('x')")
    tree = trees.whole_tree(spark, str(root))
    assert sorted(r.path for r in index.changed(tree, first).collect()) == ["b.py", "c.js"]
    assert {r.path: r.imports for r in index.refresh(first, tree).collect()} == {"a.py": ["os"], "b.py": ["json"], "c.js": ["x"]}
    seen = []
    index.follow(spark, str(root), f"{tmp_path}/check", lambda rows, _: seen.extend((r.path.rpartition("/")[2], r.imports) for r in rows.collect())).awaitTermination()
    assert sorted(seen) == [("a.py", ["os"]), ("b.py", ["json"]), ("c.js", ["x"])]
