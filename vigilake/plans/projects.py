"""Queries over authored source files, scanner reports and headers, each paired with rows of the driver's tables; answers derived by hand."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import calls as K
from ..operators import claims as C
from ..operators import hooks as H
from ..operators import pages as P
from ..operators import traffic as T
from ..sources import trees
from .audit import keyed, paired, read

#: path, content; calls (called, function, its line, first and last line); hooks (function, type, severity, class, line, called);
#: chunks (kind, name, class around, signature, first and last line); why it cannot be read.
FILES = [
    (
        "app/a.py",
        'import os\nfrom flask import request\n\n\n@app.route("/x")\ndef login(user):\n    os.system(user)\n    return eval(user)\n\n\nclass Store:\n    def get(self, q):\n        def inner():\n            return self.cur.execute(q)\n        return inner()\n\n\nrun()(1)\n',
        [("route", None, 0, 5, 5), ("system", "login", 6, 7, 7), ("eval", "login", 6, 8, 8), ("execute", "inner", 13, 14, 14), ("inner", "get", 12, 15, 15), ("run", None, 0, 18, 18), ("run", None, 0, 18, 18)],
        [("login", "CWE-78", "high", "CWE-78", 7, "system"), ("login", "CWE-94", "critical", "CWE-94", 8, "eval"), ("inner", "CWE-89", "high", "CWE-89", 14, "execute"), ("run", "CWE-78", "high", "CWE-78", 18, "run"), ("run", "CWE-78", "high", "CWE-78", 18, "run")],
        [("function", "<unknown>", None, '@app.route("/x")', 5, 8), ("function", "login", None, "def login(user):", 6, 8), ("class", "Store", None, "class Store:", 11, 15), ("function", "get", "Store", "def get(self, q):", 12, 15), ("function", "inner", "Store", "def inner():", 13, 14)],
        None,
    ),
    (
        "web/a.js",
        "const cp = require('child_process');\nfunction find(q) {\n  cp.exec(`grep ${q}`, (err, out) => {\n    show(out);\n  });\n}\nclass View {\n  render(text) { return eval(text); }\n}\napp.get('/x', async q => find(q));\n",
        [("require", None, 0, 1, 1), ("exec", "find", 2, 3, 5), ("show", "find", 2, 4, 4), ("eval", "render", 8, 8, 8), ("get", None, 0, 10, 10), ("find", None, 0, 10, 10)],
        [("require", "CWE-913", "medium", "CWE-913", 1, "require"), ("find", "CWE-78", "high", "CWE-78", 3, "exec"), ("render", "CWE-94", "critical", "CWE-94", 8, "eval")],
        [("function", "find", None, "function find(q) {", 2, 6), ("function", "<unknown>", None, "(err, out) => {", 3, 5), ("class", "View", None, "class View {", 7, 9), ("method", "render", "View", "render(text) { return eval(text); }", 8, 8), ("function", "q", None, "async q => find(q)", 10, 10)],
        None,
    ),
    (
        "src/A.java",
        "package x;\n\n@Service\npublic class A {\n    private int n;\n\n    public A(int n) {\n        this.n = n;\n    }\n\n    public Object load(ObjectInputStream in) throws IOException {\n        Runtime.getRuntime().exec(name);\n        log.info(n);\n        return in.readObject();\n    }\n}\n",
        [("Runtime", "load", 11, 12, 12), ("exec", "load", 11, 12, 12), ("log", "load", 11, 13, 13), ("in", "load", 11, 14, 14)],
        [("load", "CWE-78", "high", "CWE-78", 12, "exec")],
        [("class", "A", None, "@Service", 3, 16), ("method", "A", "A", "public A(int n) {", 7, 9), ("method", "load", "A", "public Object load(ObjectInputStream in) throws IOException {", 11, 15)],
        None,
    ),
    (
        "src/B.java",
        "class B {\n    Object o = new ProcessBuilder(x);\n    void f() { s.readUnshared(); }\n}\n",
        [("s", "f", 3, 3, 3)],
        [("", "CWE-78", "critical", "CWE-78", 2, ""), ("", "CWE-502", "critical", "CWE-502", 3, "")],
        [("class", "B", None, "class B {", 1, 4), ("method", "f", "B", "void f() { s.readUnshared(); }", 3, 3)],
        None,
    ),
    (
        "main.go",
        'package main\n\nfunc (s *Server) run(w http.ResponseWriter, r *http.Request) {\n\tname := r.FormValue("n")\n\tout, err := exec.Command("sh", "-c", name).Output()\n\tgo func() { s.log(out) }()\n}\n\nfunc main() {\n\thttp.HandleFunc("/", run)\n}\n',
        [("FormValue", "run", 3, 4, 4), ("Command", "run", 3, 5, 5), ("Output", "run", 3, 5, 5), ("log", "<anonymous>", 6, 6, 6), ("HandleFunc", "main", 9, 10, 10)],
        [("run", "input_source", "medium", None, 4, "FormValue"), ("run", "dangerous_call", "critical", None, 5, "Command"), ("main", "route_entry", "medium", None, 10, "HandleFunc")],
        [("method", "run", None, "func (s *Server) run(w http.ResponseWriter, r *http.Request) {", 3, 7), ("function", "main", None, "func main() {", 9, 11)],
        None,
    ),
    (
        "p/x.php",
        "<?php\nfunction f($a) { return unserialize($a); }\nclass K { public function go() { echo 1; } }\n",
        [],
        [("", "CWE-502", "high", "CWE-502", 2, "")],
        [("function", "f", None, "function f($a) { return unserialize($a); }", 2, 2), ("class", "K", None, "class K { public function go() { echo 1; } }", 3, 3), ("method", "go", "K", "public function go() { echo 1; }", 3, 3)],
        None,
    ),
    (
        "c/m.cpp",
        "#include <string.h>\nstruct P { int a; };\nstatic int copy(char *d, const char *s) {\n  strcpy(d, s);\n  p.exec(s);\n  return system(s);\n}\n",
        [("strcpy", "copy", 3, 4, 4), ("system", "copy", 3, 6, 6)],
        [("copy", "dangerous_call", "high", None, 4, "strcpy"), ("copy", "dangerous_call", "critical", None, 6, "system")],
        [("function", "P", None, "struct P { int a; }", 2, 2), ("function", "copy", None, "static int copy(char *d, const char *s) {", 3, 7)],
        None,
    ),
    ("app/broken.py", "def f(:\n", [], [], [], "Parse error: SyntaxError"),
    ("app/empty.py", "", [], [], [], None),
    ("notes.txt", "exec(1)", [], [], [], "Unsupported file type"),
    ("app/null.py", None, [], [], [], "No content"),
]

#: JSON of a scanner's report; @ is the document. The second result repeats the first one's place and check.
SAST = (
    '{"results":[{"check_id":"a.b.sql","path":"p@.py","start":{"line":3},"end":{"line":4},"extra":{"severity":"ERROR","lines":"q(x)","message":"m","metadata":{"cwe":["CWE-89"],"source":"s"}}},'
    '{"check_id":"a.b.sql","path":"p@.py","start":{"line":3},"end":{"line":4},"extra":{"severity":"INFO","lines":"again"}},'
    '{"check_id":"xss","path":"p@.py","start":{"line":9},"end":{"line":9},"extra":{"severity":"warning","message":"only a message"}},'
    '{"path":"p@.py","start":{"line":1},"extra":{"severity":"odd"}}]}'
)
_SAST_TYPE = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,lines:string,message:string,metadata:struct<cwe:array<string>,owasp:array<string>,source:string>>>>>"

#: Headers; then signed in, anonymous.
HEADERS = [
    ({"Cookie": "a=1"}, True, False), ({":authority": "x"}, True, True), ({"Authorization": "Bearer x"}, False, False), ({"Accept": "*/*"}, False, True),
    ({":authority": "x", "authorization": "b"}, True, False), ({"X": "my COOKIE jar"}, True, False), ({}, False, True),
]

#: category, class; then the check and the second step of the guide.
ROUTES = [
    ("security_header", "CWE-693", "headers", "2. Follow where the arguments come from"), ("cookie_security", None, "cookies", "2. Follow where the arguments come from"),
    ("x", "CWE-89", "sql", "2. Follow where the arguments come from"), ("NoSQL", None, "sql", "2. Follow where the arguments come from"), ("x", "CWE-78", "command", "2. Follow where the arguments come from"),
    ("Command_injection", "", "command", "2. Follow where the arguments come from"), ("cors_misconfig", "CWE-942", "cors", "2. Follow how the arguments of load() are made"), ("endpoint_exposure", "CWE-200", "endpoint", "2. Follow where the arguments come from"),
    ("x", "CWE-502", "guide", "2. Find who calls load()"), ("x", "CWE-94", "guide", "2. Follow how the arguments of load() are made"), ("x", "CWE-22", "guide", "2. See whether the path is made of user input"), (None, None, "guide", "2. Follow where the arguments come from"),
]

#: Technologies; how many paths they and the general ones make.
TECHS = [([], 17), (["Nginx"], 19), (["Flask"], 22), (["Django", "Next.js"], 23), (["Unknown"], 17), (["Spring", "Express"], 25)]

#: A body; its canonical form.
BODIES = [
    ('{"b": 1, "a": [1.0, "é", null]}', '{"a": [1.0, "\\u00e9", null], "b": 1}'), ("  plain text \n", "plain text"), ("[2, 1]", "[2, 1]"), ('{"a": {"d": 1, "c": true}}', '{"a": {"c": true, "d": 1}}'), ("{broken", "{broken"),
    ("", ""), (None, ""), ("12", "12"), ("x" * 2500, "x" * 2000),
]

#: Statuses before, asked or not, an answer; status after.
STATES = [
    ("pending", False, None, "pending"), ("pending", True, None, "analyzing"), ("analyzing", True, None, "analyzing"), ("pending", True, '{"finding": null}', "verified"), ("analyzing", False, '{"finding": {"is_vulnerable": false}}', "false_positive"),
    ("verified", True, '{"finding": {"is_vulnerable": false}}', "verified"), ("pending", True, "no answer", "analyzing"), ("analyzing", True, '{"finding": {"title": "x"}}', "verified"),
]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "documents"), "doc_id", [f[:2] for f in FILES], "path string, content string")
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("/"), "path").alias("path"), H.language_of(F.col("path")).alias("language"), "content")


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return K.errors(_files(spark, sf)).select("path", "error")


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return H.extraction_summary(files, K.extract(files), K.errors(files))


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return H.buckets(K.extract(_files(spark, sf)), ["path", "line_start", "called"]).select("bucket", "place", "line")


def _sast(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace(F.lit(SAST), F.lit("@"), F.col("doc_id").cast("string"))
    raw = read(spark, sf, "documents").select(F.from_json(text, _SAST_TYPE).alias("r")).select("r.results")
    return trees.sast_rows(raw).select("hook_id", "path", "line_start", "line_end", "check_id", "func_name", "severity", "snippet", "confidence")


def _split(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "events"), "event_id", [(h,) for h, *_ in HEADERS], "headers map<string,string>")
    return rows.select("id", T.signed_in(F.col("headers")).alias("signed_in"), T.anonymous(F.col("headers")).alias("anonymous"))


def _auth(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.create_map(F.concat(F.lit("X-Token-"), (F.col("user_id") % 9).cast("string")), F.col("event_id").cast("string"), F.lit("Accept"), F.lit("*/*")).alias("headers"))
    return T.auth_headers(e)


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "pages"), "page_id", [r[:2] for r in ROUTES], "category string, cwe string")
    guide = P.look_for(F.col("cwe"), F.lit("a.py"), F.col("id"), F.lit("load"))
    return rows.select("id", P.check_route(F.col("category"), F.col("cwe")).alias("route"), F.element_at(guide, 2).alias("second"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "pages"), "page_id", [(t,) for t, _ in TECHS], "found array<string>")
    return rows.select("id", F.size(P.paths_for(F.col("found"))).alias("n"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "pages"), "page_id", [(b,) for b, _ in BODIES], "body string")
    return rows.select("id", T.canonical_json("body").alias("canonical"))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    rows = paired(read(spark, sf, "documents"), "doc_id", [s[:3] for s in STATES], "status string, asked boolean, raw string")
    hooks = rows.select(F.col("id").alias("hook_id"), "status", F.lit(0.25).alias("confidence"))
    after = A.advance(hooks, rows.where("asked").select(F.col("id").alias("hook_id")), rows.where("raw is not null").select(F.col("id").alias("hook_id"), "raw"))
    return after.select("hook_id", "status")


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as chunks of orders."""
    n = F.col("l_linenumber").cast("string")
    start = F.col("l_partkey") % 200 + 1
    rows = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("def f"), n, F.lit("()")).alias("signature"),
        F.concat(F.lit("return "), F.col("l_suppkey").cast("string")).alias("body"), start.alias("line_start"), (start + F.col("l_linenumber")).alias("line_end"),
    )
    hooks = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("hook_id"), F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("f"), (F.col("o_custkey") % 4).cast("string")).alias("func"))
    return hooks, rows


def _nearby(spark: SparkSession, sf: str) -> DataFrame:
    hooks, chunks = _near(spark, sf)
    return K.nearby(K.chunk_of_hook(hooks, chunks), chunks).select("hook_id", F.col("place").cast("int").alias("place"), "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """What an auditor is asked about each order as a hook."""
    hooks, chunks = _near(spark, sf)
    of = K.chunk_of_hook(hooks, chunks)
    k = F.col("o_orderkey")
    told = read(spark, sf, "orders").select(
        k.cast("string").alias("hook_id"), k.cast("string").alias("path"), F.lit(1).cast("long").alias("line_start"), F.lit(2).cast("long").alias("line_end"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("risk_reason"),
        F.when(k % 3 == 0, F.format_string('{"description":"d%d"}', F.col("o_custkey"))).when(k % 3 == 1, "no object").alias("metadata"), F.when(k % 5 > 0, F.col("o_orderstatus")).otherwise("").alias("snippet"),
    )
    files = read(spark, sf, "orders").where("o_orderkey % 4 > 0").select(k.cast("string").alias("path"), F.concat(F.lit("file "), k.cast("string")).alias("content"))
    return A.audit_context(told, of, K.nearby(of, chunks), files)


def _subdomains(spark: SparkSession, sf: str) -> DataFrame:
    page = read(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    html = F.concat(F.lit("<a href='https://a."), host, F.lit("/x'> HTTP://A."), F.upper(host), F.lit(" http://b."), host, F.lit(" http://else.example.invalid https://a."), host)
    return page.select("page_id", F.array_join(P.subdomains(html, host, F.array(F.concat(F.lit("b."), host))), ",").alias("found"))


#: Lines that import something, by file.
IMPORTS = {"app/a.py": ["import os", "from flask import request"], "web/a.js": ["const cp = require('child_process');"], "c/m.cpp": ["#include <string.h>"]}
#: Names that a file assigns or takes as parameters, sorted, and modules that it imports, by the patterns.
INDEX = {
    "app/a.py": (["Store", "self", "user"], ["flask", "os", "request"]), "web/a.js": (["async", "const", "cp"], ["child_process"]), "src/A.java": ([], []), "src/B.java": (["Object"], []), "main.go": (["err", "name"], ["/", "-c", "n", "sh"]),
    "p/x.php": ([], []), "c/m.cpp": (["char"], []), "app/broken.py": ([], []), "app/empty.py": ([], []), "notes.txt": ([], []),
}


def _index(spark: SparkSession, sf: str) -> DataFrame:
    told = lambda c: F.array_join(F.array_sort(c), ",")
    return C.project_index(_files(spark, sf)).select("path", told("variables").alias("variables"), told("imports").alias("imports"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "file_calls": lambda s, d: K.calls(_files(s, d)).drop("language", "snippet"),
        "calls_by_sweep": lambda s, d: K.calls_by_sweep(_files(s, d)),
        "hook_snippets": lambda s, d: K.extract(_files(s, d)).select("path", "line_start", "called", "snippet"),
        "file_hooks": lambda s, d: K.extract(_files(s, d)).select("path", "func", "hook_type", "severity", "cwe", "line_start", "called"),
        "file_chunks": lambda s, d: K.chunks(_files(s, d)).select("path", "kind", "name", "parent", "signature", "line_start", "line_end", "chunk_id"),
        "file_errors": _errors,
        "chunk_contexts": lambda s, d: K.chunk_contexts(_files(s, d), with_body=False).select("path", "context"),
        "project_index": _index,
        "extraction_summary": _summary,
        "chunk_summary": lambda s, d: K.chunk_summary(_files(s, d)),
        "hook_buckets": _buckets,
        "project_type": lambda s, d: H.project_type(_files(s, d)),
        "project_files": lambda s, d: trees.file_list(_files(s, d).where("content is not null").withColumn("length", F.length("content"))).select("line"),
        "chunk_of_hook": lambda s, d: K.chunk_of_hook(*_near(s, d)).select("hook_id", "func", "line_start", "line_end", "snippet"),
        "nearby_chunks": _nearby,
        "audit_context": _asked,
        "sast_ingest": _sast,
        "traffic_split": _split,
        "auth_headers": _auth,
        "check_routes": _routes,
        "tech_paths": _paths,
        "canonical_bodies": _bodies,
        "audit_states": _states,
        "subdomains": _subdomains,
    }


def _rows(of: Callable[[tuple], list[tuple]]) -> list[tuple]:
    return [(k, f[0], *row) for k, f in enumerate(FILES) for row in of(f)]


_NEAR = "'// ' || c.name || ' (lines ' || cast(c.a as varchar) || '-' || cast(c.b as varchar) || ', type=function)' || chr(10) || c.sig || chr(10) || c.body"


def _expected(of: Callable[[tuple], list[tuple]], columns: str) -> str:
    """FROM: each document with the rows of its file; p is the file's path."""
    return keyed("documents", "doc_id", len(FILES), _rows(of), "p, " + columns)


def _shown(file: tuple, hook: tuple) -> str:
    """What a hook shows: of a call its lines and two around them, of a line scan the line."""
    lines, first = file[1].split("\n"), hook[4]
    if not hook[5]:
        return lines[first - 1].rstrip()
    last = next(b for called, _, _, a, b in file[2] if (called, a) == (hook[5], first))
    return "\n".join((">>>" if n == first else "   ") + str(n).rjust(4) + "  " + lines[n - 1] for n in range(max(1, first - 2), min(len(lines), last + 2) + 1))


_PATH = "cast(t.doc_id as varchar) || '/' || p"


def oracle_sql() -> dict[str, str]:
    hooks = _expected(lambda f: f[3], "func, hook_type, severity, cwe, line, called")
    chunks = _expected(lambda f: f[4], "kind, name, parent, signature, a, b")
    errors = _expected(lambda f: [(f[5],)] if f[5] else [], "error")
    language = "case when ends_with(p, '.py') then 'python' when ends_with(p, '.js') then 'javascript' when ends_with(p, '.java') then 'java' when ends_with(p, '.go') then 'go' when ends_with(p, '.php') then 'php' else 'cpp' end"
    files = keyed("documents", "doc_id", len(FILES), [(k, f[0], len(f[1])) for k, f in enumerate(FILES) if f[1] is not None], "p, size")
    chunk = "select cast(l_orderkey as varchar) as path, 'f' || cast(l_linenumber % 3 as varchar) as name, 'def f' || cast(l_linenumber as varchar) || '()' as sig, 'return ' || cast(l_suppkey as varchar) as body, l_partkey % 200 + 1 as a, l_partkey % 200 + 1 + l_linenumber as b from lineitem"
    hook = "select cast(o_orderkey as varchar) as hook_id, 'f' || cast(o_custkey % 4 as varchar) as func from orders"
    of_hook = f"with c as ({chunk}), h as ({hook}), f as (select path, name, min({{'a': a, 'b': -b, 'sig': sig, 'body': body}}) as x from c group by 1, 2), m as (select hook_id, func, x.a as line_start, -x.b as line_end, x.sig || chr(10) || x.body as snippet from h left join f on path = hook_id and name = func)"
    return {
        "file_calls": f"select {_PATH} as path, called, enclosing, cast(fl as int) as func_line, cast(a as int) as line_start, cast(b as int) as line_end from {_expected(lambda f: f[2], 'called, enclosing, fl, a, b')}",
        "calls_by_sweep": f"select {_PATH} as path, called, enclosing, cast(fl as int) as func_line, cast(a as int) as line_start, cast(b as int) as line_end from {_expected(lambda f: f[2], 'called, enclosing, fl, a, b')}",
        "hook_snippets": f"select {_PATH} as path, cast(line as int) as line_start, called, snippet from {_expected(lambda f: [(h[4], h[5], _shown(f, h)) for h in f[3]], 'line, called, snippet')}",
        "file_hooks": f"select {_PATH} as path, func, hook_type, severity, cwe, cast(line as int) as line_start, called from {hooks}",
        "file_chunks": f"select {_PATH} as path, kind, name, parent, signature, cast(a as int) as line_start, cast(b as int) as line_end, substr(sha256({_PATH} || ':' || name || ':' || cast(a as varchar)), 1, 12) as chunk_id from {chunks}",
        "file_errors": f"select {_PATH} as path, error from {errors}",
        "chunk_contexts": f"select {_PATH} as path, '{{\"chunk_id\":\"' || substr(sha256({_PATH} || ':' || name || ':' || cast(a as varchar)), 1, 12) || '\",\"file\":\"' || {_PATH} || '\",\"language\":\"' || {language} || '\",\"name\":\"' || name || '\",\"signature\":' || cast(to_json(signature) as varchar) || ',\"type\":\"' || kind || '\",\"lines\":\"' || cast(a as varchar) || '-' || cast(b as varchar) || '\",\"parent\":' || coalesce('\"' || parent || '\"', 'null') || ',\"imports\":' || imports || '}}' as context from "
        + _expected(lambda f: [(*c, json.dumps(IMPORTS.get(f[0], []), separators=(",", ":"))) for c in f[4]], "kind, name, parent, signature, a, b, imports"),
        "project_index": f"select {_PATH} as path, variables, imports from {_expected(lambda f: [(','.join(sorted(INDEX[f[0]][0])), ','.join(sorted(INDEX[f[0]][1])))] if f[0] in INDEX else [], 'variables, imports')}",
        "extraction_summary": f"""with h as (select {_PATH} as path, hook_type, severity from {hooks}), e as (select {_PATH} as path from {errors})
select 'total' as kind, 'files_scanned' as name, count(distinct path) as n from (select path from h union all select path from e) union all select 'total', 'files_with_hooks', count(distinct path) from h union all select 'total', 'total_hooks', count(*) from h union all select 'total', 'total_errors', count(*) from e
union all select 'severity', s, (select count(*) from h where severity = s) from (values ('critical'), ('high'), ('medium'), ('low'), ('info')) v(s) union all select 'type', hook_type, count(*) from h group by hook_type""",
        "chunk_summary": f"""with c as (select {_PATH} as path, kind, {language} as lang from {chunks}), e as (select {_PATH} as path from {errors})
select 'total' as kind, 'files_processed' as name, count(distinct path) as n from (select path from c union all select path from e) union all select 'total', 'files_with_chunks', count(distinct path) from c union all select 'total', 'total_chunks', count(*) from c union all select 'total', 'total_errors', count(*) from e
union all select 'type', k, (select count(*) from c where kind = k) from (values ('function'), ('method'), ('class')) v(k) union all select 'language', lang, count(*) from c group by lang""",
        "hook_buckets": f"""with h as (select {_PATH} as path, case when hook_type in ('route_entry', 'input_source') then hook_type else 'other' end as bucket, line, called, '  - ' || {_PATH} || ':' || cast(line as varchar) || ' ' || func || '() calls ' || case when called = '' then '?' else called end || '() [' || severity || ']' as told from {hooks}),
r as (select bucket, row_number() over (partition by bucket order by path, line, called, told) as place, told as line from h) select bucket, cast(place as int) as place, line from r where place <= case bucket when 'other' then 30 else 20 end""",
        "project_type": "select 'Python Web Application (Flask/FastAPI/Django)' as project_type",
        "project_files": f"select '  ' || path || ' (' || cast(size as varchar) || ' bytes)' as line from (select {_PATH} as path, size from {files}) order by path limit 50",
        "chunk_of_hook": f"{of_hook} select * from m",
        "nearby_chunks": f"{of_hook}, n as (select hook_id, cast(row_number() over (partition by hook_id order by c.a, -c.b, c.name, '// ' || c.name || ' (lines ' || cast(c.a as varchar) || '-' || cast(c.b as varchar) || ', type=function)' || chr(10) || c.sig || chr(10) || c.body) as int) as place, '// ' || c.name || ' (lines ' || cast(c.a as varchar) || '-' || cast(c.b as varchar) || ', type=function)' || chr(10) || c.sig || chr(10) || c.body as text from m join c on c.path = hook_id and c.name <> func and abs(c.a - line_start) <= 50 where line_start is not null) select * from n where place <= 3",
        "audit_context": f"""{of_hook}, n as (select hook_id, row_number() over (partition by hook_id order by c.a, -c.b, c.name, {_NEAR}) as place, {_NEAR} as text from m join c on c.path = hook_id and c.name <> func and abs(c.a - line_start) <= 50 where line_start is not null),
x as (select hook_id, string_agg(text, chr(10) || chr(10) order by place) as around from n where place <= 3 group by 1)
select m.hook_id, coalesce(line_start, 1) as line_start, coalesce(line_end, 2) as line_end, case when o_orderkey % 3 = 0 then 'd' || cast(o_custkey as varchar) when o_orderkey % 2 = 0 then o_orderpriority else 'Suspicious call detected' end as risk_reason,
  coalesce(m.snippet, case when o_orderkey % 4 > 0 then 'file ' || cast(o_orderkey as varchar) end, case when o_orderkey % 5 > 0 then o_orderstatus end, case when o_orderkey % 2 = 0 then o_orderpriority end, '(unable to extract code)') as snippet,
  coalesce(around, '(no additional context available)') as context from m join orders on m.hook_id = cast(o_orderkey as varchar) left join x on x.hook_id = m.hook_id""",
        "sast_ingest": f"select substr(sha256('p' || cast(doc_id as varchar) || '.py:' || func_name || ':' || cast(a as varchar)), 1, 16) as hook_id, 'p' || cast(doc_id as varchar) || '.py' as path, cast(a as int) as line_start, cast(b as int) as line_end, check_id, func_name, severity, snippet, cast(30.0 as double) as confidence from documents, (values (3, 4, 'a.b.sql', 'sql', 'high', 'q(x)'), (9, 9, 'xss', 'xss', 'medium', 'only a message'), (1, null, 'unknown', 'unknown', 'info', '')) v(a, b, check_id, func_name, severity, snippet)",
        "traffic_split": f"select event_id as id, signed_in, anonymous from {keyed('events', 'event_id', len(HEADERS), [(k, *h[1:]) for k, h in enumerate(HEADERS)], 'signed_in, anonymous')}",
        "auth_headers": "select 'X-Token-' || cast(user_id % 9 as varchar) as name, count(*) as n, sha256(cast(max(event_id) as varchar)) as last_sha256 from events group by user_id % 9",
        "check_routes": f"select page_id as id, route, second from {keyed('pages', 'page_id', len(ROUTES), [(k, *r[2:]) for k, r in enumerate(ROUTES)], 'route, second')}",
        "tech_paths": f"select page_id as id, cast(n as int) as n from {keyed('pages', 'page_id', len(TECHS), [(k, n) for k, (_, n) in enumerate(TECHS)], 'n')}",
        "canonical_bodies": f"select page_id as id, canonical from {keyed('pages', 'page_id', len(BODIES), [(k, c) for k, (_, c) in enumerate(BODIES)], 'canonical')}",
        "audit_states": f"select doc_id as hook_id, status from {keyed('documents', 'doc_id', len(STATES), [(k, s[3]) for k, s in enumerate(STATES)], 'status')}",
        "subdomains": "with h as (select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) as host from pages) select page_id, array_to_string(list_sort(['A.' || upper(host), 'a.' || host]), ',') as found from h",
    }
