"""Queries over findings and captured pages, and the SQL that they must equal. Authored texts are paired with rows by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import calls as K
from ..operators import claims as C
from ..operators import pages as P

CLAIMS = [
    "The file 'app.py' calls run_query() and then run_query() again. Severity: high for CWE-89.",
    "In \"lib/missing.py\" the value is always set.\n\nIt is never read. Severity: low, CWE-787.",
    "It is always safe and never fails in 'http://x.example/a.html'. severity: medium CWE-200",
    "load_data() fails, load_data() again; print() print() login() login(). From core/db.go it reads path \" conf0.yml \".",
    "",
    None,
    "See File \"src/x.ts\" and path 'docs/readme.md'; from 'core/db.go' nothing.",
    "severity critical: it never returns. CWE-22",
    "check_input() once; then do_it() do_it() do_it(); is_ok()is_ok().",
    "ALWAYS\nnever, from util.py on. Severity:  medium, not CWE-862 alone",
]
#: Derived by hand from the texts above, by their place: names of files that are none, functions that are none with how often, (contradiction, wrong severity).
NO_FILES = [(1, "lib/missing.py"), (3, "conf0.yml"), (6, "src/x.ts"), (6, "docs/readme.md"), (6, "src/x.ts"), (6, "docs/readme.md"), (9, "util.py")]
NO_FUNCTIONS = [(0, "run_query", 2), (3, "load_data", 2), (8, "do_it", 3), (8, "is_ok", 2)]
LOGIC = [(False, False), (False, True), (True, False), (False, False), (False, False), (False, False), (False, False), (False, True), (False, False), (True, False)]
FILES, FUNCTIONS = ["app.py", "core/db.go"], ["login"]
#: Set-Cookie, Access-Control-Allow-Origin, Access-Control-Allow-Credentials, other header names
CAPTURED = [
    ("sid=1; Secure; HttpOnly; SameSite=Lax", "*", "true", "x-frame-options"),
    ("a=1; Secure, b=2; Expires=Wed, 01 Jan; HttpOnly", "*", None, "Referrer-Policy"),
    (None, "https://a.example", "true", "CONTENT-SECURITY-POLICY"),
    ("", None, None, "Server"),
]
#: Of these, by hand: headers that are missing, cookies with what they lack.
MISSING = [
    "Strict-Transport-Security,Content-Security-Policy,X-Content-Type-Options,Referrer-Policy,Permissions-Policy",
    "Strict-Transport-Security,Content-Security-Policy,X-Frame-Options,X-Content-Type-Options,Permissions-Policy",
    "Strict-Transport-Security,X-Frame-Options,X-Content-Type-Options,Referrer-Policy,Permissions-Policy",
    "Strict-Transport-Security,Content-Security-Policy,X-Frame-Options,X-Content-Type-Options,Referrer-Policy,Permissions-Policy",
]
WEAK = ["", "a: missing HttpOnly, SameSite; b: missing Secure, HttpOnly, SameSite; 01 Jan; HttpOnly: missing Secure, SameSite", "", ""]
#: path, content
SOURCES = [
    ("app/a.py", "import os\n\n\ndef login(user):\n    os.system(user)\n    return eval(user)\n"),
    ("app/b.py", "class Store:\n    def get(self, q):\n        def inner():\n            return self.cur.execute(q)\n        return inner()\n\n\nrun()(1)"),
    ("app/broken.py", "def f(:\n"),
    ("app/empty.py", ""),
]


def _q(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join(f"({i}, {', '.join(_q(x) for x in r)})" for i, r in enumerate(rows)) + ")"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _paired(rows: DataFrame, key: str, table: list[tuple], names: str) -> DataFrame:
    """Each row with one authored row, chosen by key."""
    columns = names.split()
    authored = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(table)], "k long, " + ", ".join(f"{c} string" for c in columns))
    return rows.select(F.col(key).alias("id"), (F.col(key) % len(table)).alias("k")).join(F.broadcast(authored), "k").select("id", *columns)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(_t(spark, sf, "documents"), "doc_id", [(c,) for c in CLAIMS], "text")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    files = _paired(_t(spark, sf, "documents"), "doc_id", SOURCES, "path content")
    return files.select("id", F.concat(F.col("id").cast("string"), F.lit("/"), F.col("path")).alias("path"), "content")


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def _captured(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(_t(spark, sf, "pages"), "page_id", CAPTURED, "cookie origin credentials other")


_CATEGORIES = [*R.VENDOR_CATEGORIES, "logic_flaw"]
_LEVELS, _TIERS = ["high", "medium", "low", "critical"], ["default", "tier_a", "tier_b", "elsewhere", "elsewhere too"]


def _pick(table: list[str], key: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, table)), (key % len(table) + 1).cast("int"))


def _vendor(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    events = _t(spark, sf, "events").select(e, _pick(_CATEGORIES, e).alias("category"), _pick(_LEVELS, F.floor(e / 7)).alias("severity"), _pick(_TIERS, F.floor(e / 3)).alias("tier"))
    return P.vendor_check(events)


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of low findings under the default tier."""
    rows = _t(spark, sf, "events").select("event_id", _pick(_CATEGORIES, F.col("event_id")).alias("category"), F.lit("low").alias("severity"), F.lit("default").alias("tier"))
    return P.without_rejected(P.vendor_check(rows)).select("event_id", "category", "vendor_category")


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    points = C.ladder(F.col("quality") == 1, F.col("toxic") == 0, F.col("lang") == "en", F.col("n_chars") > 500)
    return rows.select("doc_id", points.cast("int").alias("points"), (points >= 60).alias("submit"))


#: html, base; addresses found, sorted. Derived by hand.
SCRIPTS = [
    ('<script src="/a.js"></script><SCRIPT async src=\'b.js\'></script>', "https://h.example:8/x/y.html?q=/z", "https://h.example:8/a.js,https://h.example:8/x/b.js"),
    ('<script src="//c.example/c.js"></script><script defer src="https://d.example/d.js">', "http://h.example/", "https://c.example/c.js,https://d.example/d.js"),
    ('<script src="/a.js"></script><script src=\'/a.js\'></script><script>x()</script>', "http://h.example", "http://h.example/a.js"),
    ("<p>no scripts</p>", "http://h.example", ""),
    ("", "http://h.example/a/", ""),
]


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(_t(spark, sf, "pages"), "page_id", [s[:2] for s in SCRIPTS], "html base")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "halluc_files": lambda s, d: C.file_claims(_claims(s, d), _names(s, FILES)),
        "halluc_functions": lambda s, d: C.function_claims(_claims(s, d), _names(s, FUNCTIONS)),
        "halluc_logic": lambda s, d: _claims(s, d).select("id", C.contradiction(F.col("text")).alias("contradiction"), C.wrong_severity(F.col("text")).alias("wrong_severity")),
        "header_check": lambda s, d: _captured(s, d).select("id", F.array_join(P.missing_headers(F.map_from_arrays(F.array("other"), F.array(F.lit("x")))), ",").alias("missing")),
        "cookie_flags": lambda s, d: _captured(s, d).select("id", F.array_join(P.weak_cookies(F.col("cookie")), "; ").alias("weak")),
        "cors_check": lambda s, d: _captured(s, d).select("id", P.cors_severity(F.col("origin"), F.col("credentials")).alias("severity")),
        "vendor_filter": _vendor,
        "reject_category": _kept,
        "script_urls": lambda s, d: _scripts(s, d).select("id", F.array_join(P.script_urls(F.col("html"), F.col("base")), ",").alias("found")),
        "host_roots": lambda s, d: _t(s, d, "pages").select("page_id", P.root_of(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("root")),
        "confidence_ladder": _ladder,
        "context_snippet": lambda s, d: _sources(s, d).select("id", K.context(F.col("content"), (F.col("id") % 6 + 1).cast("int")).alias("snippet")).where("snippet <> ''"),
    }


_CAPTURED = f"with f as (select page_id as id, v.* exclude (k) from pages join {_values(CAPTURED)} v(k, cookie, origin, credentials, other) on page_id % {len(CAPTURED)} = v.k)"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(map(_q, names)) + "]"


_ACCEPTS = "(values " + ", ".join(f"({_q(t)}, {_q(s)}, {_q(c)})" for t, rows in R.VENDOR_ACCEPTS.items() for s, names in rows.items() for c in names) + ") a(t, s, c)"
_MAPPED = "case category " + " ".join(f"when {_q(a)} then {_q(b)}" for a, b in R.VENDOR_CATEGORIES.items()) + " else category end"
_CHOSEN = f"{_list(_CATEGORIES)}[event_id % {len(_CATEGORIES)} + 1]"


def oracle_sql() -> dict[str, str]:
    return {
        "halluc_files": lambda s, d: C.file_claims(_claims(s, d), _names(s, FILES)),
        "halluc_functions": lambda s, d: C.function_claims(_claims(s, d), _names(s, FUNCTIONS)),
        "halluc_logic": lambda s, d: _claims(s, d).select("id", C.contradiction(F.col("text")).alias("contradiction"), C.wrong_severity(F.col("text")).alias("wrong_severity")),
        "header_check": lambda s, d: _captured(s, d).select("id", F.array_join(P.missing_headers(F.map_from_arrays(F.array("other"), F.array(F.lit("x")))), ",").alias("missing")),
        "cookie_flags": lambda s, d: _captured(s, d).select("id", F.array_join(P.weak_cookies(F.col("cookie")), "; ").alias("weak")),
        "cors_check": lambda s, d: _captured(s, d).select("id", P.cors_severity(F.col("origin"), F.col("credentials")).alias("severity")),
        "vendor_filter": _vendor,
        "reject_category": _kept,
        "host_roots": lambda s, d: _t(s, d, "pages").select("page_id", P.root_of(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("root")),
        "confidence_ladder": _ladder,
        "context_snippet": lambda s, d: _sources(s, d).select("id", K.context(F.col("content"), (F.col("id") % 6 + 1).cast("int")).alias("snippet")).where("snippet <> ''"),
    }


_CLAIMED = f"with f as (select doc_id as id, v.text from documents join {_values([(c,) for c in CLAIMS])} v(k, text) on doc_id % {len(CLAIMS)} = v.k)"
_CAPTURED = f"with f as (select page_id as id, v.* exclude (k) from pages join {_values(CAPTURED)} v(k, cookie, origin, credentials, other) on page_id % {len(CAPTURED)} = v.k)"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(map(_q, names)) + "]"


_ACCEPTS = "(values " + ", ".join(f"({_q(t)}, {_q(s)}, {_q(c)})" for t, rows in R.VENDOR_ACCEPTS.items() for s, names in rows.items() for c in names) + ") a(t, s, c)"
_MAPPED = "case category " + " ".join(f"when {_q(a)} then {_q(b)}" for a, b in R.VENDOR_CATEGORIES.items()) + " else category end"
_CHOSEN = f"{_list(_CATEGORIES)}[event_id % {len(_CATEGORIES)} + 1]"


def oracle_sql() -> dict[str, str]:
    named = " || ".join(f"cast([x for x in regexp_extract_all(text, {_q(p)}, 1)] as varchar[])" for p in R.FILE_CLAIMS)
    return {
        "halluc_files": f"select doc_id as id, v.name from documents join (values {', '.join(f'({k}, {_q(n)})' for k, n in NO_FILES)}) v(k, name) on doc_id % {len(CLAIMS)} = v.k",
        "halluc_functions": f"select doc_id as id, v.name, cast(v.n as bigint) as n from documents join (values {', '.join(f'({k}, {_q(f)}, {n})' for k, f, n in NO_FUNCTIONS)}) v(k, name, n) on doc_id % {len(CLAIMS)} = v.k",
        "halluc_logic": f"select doc_id as id, v.c as contradiction, v.w as wrong_severity from documents join (values {', '.join(f'({k}, {c}, {w})' for k, (c, w) in enumerate(LOGIC))}) v(k, c, w) on doc_id % {len(CLAIMS)} = v.k",
        "header_check": f"select page_id as id, v.missing from pages join {_values([(m,) for m in MISSING])} v(k, missing) on page_id % {len(CAPTURED)} = v.k",
        "cookie_flags": f"select page_id as id, v.weak from pages join {_values([(w,) for w in WEAK])} v(k, weak) on page_id % {len(CAPTURED)} = v.k",
        "cors_check": f"{_CAPTURED} select id, case when origin = '*' and credentials = 'true' then 'medium' when origin = '*' then 'low' end as severity from f",
        "vendor_filter": f"with e as (select event_id, {_CHOSEN} as category, {_list(_LEVELS)}[event_id // 7 % {len(_LEVELS)} + 1] as severity, {_list(_TIERS)}[event_id // 3 % {len(_TIERS)} + 1] as tier from events), m as (select *, {_MAPPED} as vendor_category from e) select *, exists (select 1 from {_ACCEPTS} where a.t = case when tier like 'else%' then 'default' else tier end and a.s = severity and a.c = vendor_category) as accepted from m",
        "reject_category": f"with e as (select event_id, {_CHOSEN} as category from events), m as (select *, {_MAPPED} as vendor_category from e) select * from m where vendor_category in (select c from {_ACCEPTS} where a.t = 'default' and a.s = 'low')",
        "script_urls": lambda s, d: _scripts(s, d).select("id", F.array_join(P.script_urls(F.col("html"), F.col("base")), ",").alias("found")),
        "script_urls": f"select page_id as id, v.found from pages join {_values([(s[2],) for s in SCRIPTS])} v(k, found) on page_id % {len(SCRIPTS)} = v.k",
        "host_roots": "with h as (select page_id, string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') as p from pages) select page_id, array_to_string(p[-2:], '.') as root from h",
        "confidence_ladder": "with p as (select d.doc_id, cast(coalesce(15 * cast(quality = 1 as int), 0) + coalesce(25 * cast(toxic = 0 as int), 0) + coalesce(10 * cast(lang = 'en' as int), 0) + coalesce(50 * cast(n_chars > 500 as int), 0) as int) as points from documents d left join labels l on d.doc_id = l.doc_id) select doc_id, points, points >= 60 as submit from p",
        "context_snippet": f"with f as (select doc_id as id, string_split(v.content, chr(10)) as ls, doc_id % 6 + 1 as ln from documents join {_values(SOURCES)} v(k, path, content) on doc_id % {len(SOURCES)} = v.k), n as (select id, array_to_string([case when i = ln then '>>>' else '   ' end || lpad(cast(i as varchar), 4, ' ') || '  ' || ls[i] for i in generate_series(greatest(ln - 2, 1), least(ln + 2, len(ls)))], chr(10)) as snippet from f) select id, snippet from n where snippet <> ''",
    }
