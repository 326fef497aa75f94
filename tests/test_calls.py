import pytest
from pyspark.sql import functions as F
from vigilake.operators import calls
from vigilake.operators.lexer import LANGUAGES, Source

HOSTILE = ["(" * 50_000, "{" * 20_000 + "f(" * 20_000, "a.b(" * 30_000, '"' * 50_001, "/" * 50_000, "<?php function " * 10_000, "x = /" * 10_000, "}" * 1000 + ")" * 1000, "class", "function", "func (", "=>", "\x00퟿\U0001f600 f(é)"]


def test_nested_calls_count_each(spark):
    files = spark.createDataFrame([("a.py", "run()(1)\n"), ("b.js", "run()(1)")], "path string, content string")
    assert calls.calls(files).count() == 4  # the inner call and the call of its result


@pytest.mark.parametrize("language", LANGUAGES)
def test_any_text_is_read(language):
    for text in HOSTILE:
        source = Source(text, language)
        n = text.count("\n") + 1
        assert all(1 <= c.line_start <= c.line_end <= n for c in source.calls()) and all(c.line_start <= c.line_end <= n for c in source.chunks())


def test_strings_comments_and_outside_of_tags_hold_no_code():
    assert Source("// f()\n/* g() */ 'h()' \"i()\" `j()` k()", "javascript").calls()[0].called == "k"
    assert [c.name for c in Source("<p>function a() {}</p><?php # function b() {}\nfunction c() {} ?> function d() {}", "php").chunks()] == ["c"]
    assert [c.called for c in Source('#define X f(\nchar *s = R"x(g()) )x"; int m() { return h(s); }', "cpp").calls()] == ["h"]
    assert [c.called for c in Source("a := `f()`\n/* g() */ h('(')", "go").calls()] == ["h"]
    assert [c.called for c in Source('String s = """\nf()\n"""; g(); // h()', "java").calls()] == ["g"]
    assert [c.called for c in Source("const r = /['\"(]f()/g; x / y / g(1)", "javascript").calls()] == ["g"]


def test_errors_imports_and_contexts(spark):
    rows = [("a.py", "import os\nfrom x import y\nimportant = 1\n\ndef f(): pass\n"), ("b.js", "const a = require('a');\nlet b = 2;\nimport x from 'y';\n"), ("c.go", 'import (\n  "fmt"\n)\n'), ("d.cpp", "#include <a>\nint main() { return 0; }"), ("e.java", "import a.B;\n"), ("f.php", "use X;\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    by = {r.path: r.i for r in files.select("path", F.to_json(calls.import_lines(F.col("content"), calls.language_of(F.col("path")))).alias("i")).collect()}
    assert by == {"a.py": '["import os","from x import y"]', "b.js": "[\"const a = require('a');\"]", "c.go": '["import (","\\"fmt\\""]', "d.cpp": '["#include <a>"]', "e.java": '["import a.B;"]', "f.php": "[]"}
    contexts = [r.context for r in calls.chunk_contexts(files.where("path = 'd.cpp'")).collect()]
    assert contexts[0].endswith('"name":"main","signature":"int main() { return 0; }","type":"function","lines":"2-2","parent":null,"imports":["#include <a>"],"body":"{ return 0; }"}')
    empty = files.withColumn("language", F.lit("python")).limit(0)
    assert [f(empty).count() for f in (calls.calls, calls.chunks, calls.errors, calls.extract)] == [0] * 4


def test_context(spark):
    text = "\n".join("abcde")
    got = spark.createDataFrame([(text, 1), (text, 3), (None, 1)], "t string, n int").select(calls.context(F.col("t"), F.col("n")).alias("s")).collect()
    assert got[0].s == ">>>   1  a\n      2  b\n      3  c" and got[1].s.count("\n") == 4 and ">>>   3  c" in got[1].s and got[2].s is None


def test_line_scan_only_where_calls_give_nothing(spark):
    rows = [("a.java", "class A { void f() { x.y.exec(c); new ProcessBuilder(c); } }"), ("b.java", "class A { void f() { new ProcessBuilder(c); } }")]
    got = {(r.path, r.called, r.cwe) for r in calls.extract(spark.createDataFrame(rows, "path string, content string").withColumn("language", F.lit("java"))).collect()}
    assert got == {("a.java", "exec", "CWE-78"), ("b.java", "", "CWE-78")}
