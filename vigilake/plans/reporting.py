"""Queries that write reports and use the knowledge base, and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as N
from ..operators import reports as W
from .audit import keyed, paired, quoted, read, values

_CWES = ["CWE-89", "CWE-79", None, "CWE-200", "CWE-22", "CWE-1", "CWE-89"]
_SEVERITIES = ["critical", "high", "medium", "low", "info", "odd", None]
_SNIPPETS = ["   1  a\n>>>   2  run(x)\n   3  b", "plain code", None, ">>> first\n>>> second", ""]


def _pick(table: list, key) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in table]).cast("array<string>"), (key % len(table) + 1).cast("int"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as findings."""
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        k.alias("seq"), _pick(_SEVERITIES, k).alias("severity"), _pick(_CWES, k).alias("cwe"), F.when(k % 11 > 0, F.col("c_name")).alias("title"), F.when(k % 13 > 0, F.concat(F.col("c_mktsegment"), F.lit(" fix"))).alias("description"),
        F.when(k % 17 > 0, k % 101).alias("confidence"), F.when(k % 3 == 0, "Advice").alias("remediation"), F.when(k % 19 > 0, F.concat(F.lit("src/"), F.col("c_nationkey").cast("string"), F.lit(".py"))).alias("file_path"),
        F.when(k % 23 > 0, k % 97).alias("line_start"), F.when(k % 29 > 0, "f").alias("func_name"), _pick(_SNIPPETS, k).alias("snippet"), F.when(k % 5 == 0, "true_positive").when(k % 5 == 1, "valid").otherwise("invalid").alias("verdict"),
        (k % 31 == 0).alias("verified"), F.when(k % 7 > 0, F.concat(F.lit("https://x.example/"), k.cast("string"))).alias("url"), F.when(k % 4 == 0, F.array(F.lit("open it"), F.concat(F.lit("see "), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("steps"),
        F.when(k % 6 == 0, F.lit("poc()")).alias("poc"), F.when(k % 9 == 0, F.repeat(F.lit("e"), 600)).alias("evidence"), _pick(["api_leak", "info_leak", "other"], k).alias("category"), (k % 40).alias("hook_id"), F.lit("GET").alias("method"),
    )


def _auth(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    rows = read(spark, sf, "pages").select(p.alias("seq"), F.lit("GET").alias("method"), F.concat(F.lit("/p/"), p.cast("string")).alias("path"), F.length("html").alias("size"), F.array(F.lit("userId"), F.lit("token")).alias("fields"), F.substring("html", 1, 20).alias("preview"))
    return W.auth_report(rows, "seq", "x.har", "x.example")


def _hooks(spark: SparkSession) -> DataFrame:
    return spark.range(30).select(F.col("id").alias("hook_id"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("file_path"), F.lit("run").alias("func_name"))


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf).withColumnRenamed("seq", "finding_id")
    return W.template_reports(f, _hooks(spark), "general", "2024-01-01")


#: pid, class, signature, code, rule, number of its day. Rules hold no look-ahead, so that both engines read them alike.
PATTERNS = [
    (1, "CWE-89", r"cur\.execute\(\w+\)", 'cursor.execute("SELECT" + query)', r"(execute|query|raw)\s*\(\s*(?:f[\"']|[\"'].*%)", 5),
    (2, "CWE-78", "", "os.system(cmd)", r"(os\.(?:system|popen)|subprocess\.(?:call|run|Popen))\s*\([^)]*", 9),
    (3, "CWE-79", "", "el.innerHTML = input", r"(innerHTML\s*=|document\.write\s*\()", 9),
    (4, "CWE-22", r"open\(\w+\)", "open(request.args)", "", 1),
    (5, "CWE-862", "", "", "", 2),
    (6, "CWE-78", "(broken", "exec popen system", "[", 7),
]
#: snippet, type of the hook, vector.
SNIPPETS = [
    ('cur.execute(f"x")', "injection", [1.0, 0.0, 0.0]), ("cur.execute(sql)", "unknown", [0.0, 1.0, 0.0]), ("os.system(cmd) and popen", "command_exec", [0.0, 0.0, 1.0]), ("el.INNERHTML = request.q", "input_source", [1.0, 1.0, 0.0]),
    ("short", "injection", [1.0, 0.0, 0.0]), ("nothing of note here", "unknown", [0.6, 0.8, 0.0]), ("open(name) of a file", "file_operation", [0.0, 0.0, 0.0]), ("nothing of note at all", "route_entry", None), (None, "injection", [1.0, 0.0, 0.0]),
    ("   padded   ", "injection", [1.0, 0.0, 0.0]), ("def handler(): pass", "route_entry", [-1.0, 0.0, 0.2]),
]
VECTORS = {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 1.0], 4: [1.0, 1.0, 0.0], 5: None, 6: [-1.0, 0.0, 0.0]}


def _patterns(spark: SparkSession) -> DataFrame:
    rows = [(pid, cwe, signature, code, rule, seen, VECTORS[pid]) for pid, cwe, signature, code, rule, seen in PATTERNS]
    return spark.createDataFrame(rows, "pid long, cwe_id string, code_signature string, vulnerable_snippet string, detection_rule string, seen long, v array<double>")


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "documents"), "doc_id", SNIPPETS, "snippet string, hook_type string, v array<double>")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return N.listed(N.matched(_snippets(spark, sf), _patterns(spark))).select("id", "rank", "pid", F.col("score").cast("int").alias("score"))


#: class, description, hook; of hook 0 the snippet, of hook 1 none. Then type, signature, code, rule.
EXTRACTED = [
    ("CWE-89", "d", 0, "sql_injection", r"cur\.execute\(\w+\)\ \#\ \w+", "cur.execute(query) # username", r"""(cursor\.execute|\.raw|\.execute_many)\s*\(\s*(?:f["']|[^)]*\%[^)]*|[^)]*\+[^)]*)"""),
    ("CWE-79", "show name = id", 1, "xss", r"show\ \w+\ =\ \w+", "show name = id", r"(innerHTML\s*=|dangerouslySetInnerHTML|document\.write\s*\()"),
    ("CWE-400", "  a-b.c  ", 7, "400", r"a\-b\.c", "  a-b.c  ", ""),
    ("CWE-502", None, 0, "deserialization", r"cur\.execute\(\w+\)\ \#\ \w+", "cur.execute(query) # username", ""),
    ("OTHER-1", "x", 0, None, None, None, None),
    (None, "x", 0, None, None, None, None),
]


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    findings = paired(read(spark, sf, "documents"), "doc_id", [e[:3] for e in EXTRACTED], "cwe_id string, description string, hook_id long").withColumnRenamed("id", "finding_id")
    hooks = spark.createDataFrame([(0, "cur.execute(query) # username", "python"), (1, "", "javascript")], "hook_id long, snippet string, language string")
    return N.extract_patterns(findings, hooks).select("finding_id", "pattern_type", "code_signature", "vulnerable_snippet", "detection_rule", "fix_snippet")


def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    return N.bulk_patterns(_findings(spark, sf).withColumnsRenamed({"seq": "finding_id", "cwe": "cwe_id"})).select("finding_id", "pattern_type", "vulnerable_snippet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "report_markdown": lambda s, d: W.markdown_report(_findings(s, d), "seq", "hackerone", "t", "now"),
        "report_json": lambda s, d: W.json_export(_findings(s, d), "seq", "1", "now").where("part = 2").select("seq", "line"),
        "report_scan": lambda s, d: W.scan_report(_findings(s, d), "seq", "j1", {"files_scanned": 3, "hooks_total": 4}, generated="now"),
        "report_submission": lambda s, d: W.submission_report(_findings(s, d), "seq", "x.example", "p", "2024-01-01"),
        "report_pages": lambda s, d: W.page_report(_findings(s, d), "seq", "x.example", "Nginx"),
        "report_auth": _auth,
        "report_templates": _templates,
        "cwe_counts": lambda s, d: W.cwe_counts(_findings(s, d)),
        "pattern_extract": _extracted,
        "pattern_bulk": _bulk,
        "pattern_match": _matched,
        "pattern_retrieve": lambda s, d: N.retrieve(_snippets(s, d), _patterns(s)),
    }


def _list(table: list) -> str:
    return "[" + ", ".join(map(quoted, table)) + "]"


_F = f"""f as (select c_custkey as seq, {_list(_SEVERITIES)}[c_custkey % 7 + 1] as severity, {_list(_CWES)}[c_custkey % 7 + 1] as cwe, case when c_custkey % 11 > 0 then c_name end as title, case when c_custkey % 13 > 0 then c_mktsegment || ' fix' end as description,
  case when c_custkey % 17 > 0 then c_custkey % 101 end as confidence, case when c_custkey % 3 = 0 then 'Advice' end as remediation, case when c_custkey % 19 > 0 then 'src/' || cast(c_nationkey as varchar) || '.py' end as file_path,
  case when c_custkey % 23 > 0 then c_custkey % 97 end as line_start, case when c_custkey % 29 > 0 then 'f' end as func_name, {_list(_SNIPPETS)}[c_custkey % 5 + 1] as snippet, case c_custkey % 5 when 0 then 'true_positive' when 1 then 'valid' else 'invalid' end as verdict,
  c_custkey % 31 = 0 as verified, case when c_custkey % 7 > 0 then 'https://x.example/' || cast(c_custkey as varchar) end as url, c_custkey as k, case when c_custkey % 6 = 0 then 'poc()' end as poc, case when c_custkey % 9 = 0 then repeat('e', 600) end as evidence,
  ['api_leak', 'info_leak', 'other'][c_custkey % 3 + 1] as category, c_custkey % 40 as hook_id from customer)"""
_NAMES = {"CWE-89": "SQL Injection", "CWE-79": "XSS", "CWE-22": "Path Traversal"}
_NL = "chr(10)"
_PROOF = (
    "case cwe " + " ".join(f"when '{c}' then '{n}'" for c, n in _NAMES.items()) + " else 'Finding' end || chr(10) || chr(10) || 'Vulnerable code:' || chr(10) || '```' || chr(10) || "
    "coalesce(trim(replace([x for x in string_split(snippet, chr(10)) if contains(x, '>>>')][1], '>>>', '')), substr(snippet, 1, 200), '') || chr(10) || '```' || chr(10) || chr(10) || 'Manual verification required.'"
)
_RANK = "case coalesce(severity, 'medium') when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 end"


def _lines(part: int, seq: str, lines: list[str], source: str) -> str:
    """Rows of lines; each line is an SQL expression, null ones are left out."""
    return f"select cast({part} as int) as part, cast({seq} as bigint) as seq, cast(unnest(generate_series(0, len(l) - 1)) as int) as n, unnest(l) as line from (select {seq} as q, * from (select *, [x for x in [{', '.join(lines)}] if x is not null] as l from {source}))"


def _row(name: str, value: str) -> str:
    return f"'| {name} | ' || {value} || ' |'"


_LABEL = "case severity when 'critical' then 'Critical' when 'high' then 'High' when 'medium' then 'Medium' when 'low' then 'Low' else severity end"


def _markdown() -> str:
    one = "(select count(*) as total from f)"
    head = ["'# Security Audit Report'", "''", "'- Platform: HackerOne'", "'- Generated: now'", "'- Target: t'", "'- Total Findings: ' || cast(total as varchar)", "''", "'---'", "''"]
    cwe, sev = "coalesce(cwe, 'CWE-0')", "coalesce(severity, 'medium')"
    section = [
        f"'## #' || cast(place as varchar) || ' [' || upper({sev}) || '] ' || {cwe} || ': ' || coalesce(title, 'Untitled')", "''", "'| Field | Value |'", "'|-------|-------|'", _row("CWE", cwe), _row("Severity", sev), _row("Location", "coalesce(file_path, '')"),
        _row("Confidence", "coalesce(cast(confidence as varchar), '50') || '%'"), _row("Description", "coalesce(description, '')"), _row("Remediation", "coalesce(remediation, 'Review and fix')"), "''", _PROOF, "''", "'---'", "''",
    ]
    return f"""with {_F}, shown as (select *, row_number() over (order by {_RANK}, seq) as place from f where {_RANK} is not null) {_lines(1, '0', head, one)} union all {_lines(2, 'place', section, 'shown')}
union all {_lines(3, '0', ["'## Summary'", "''"], one)} union all select 4, 0, 0, '- ' || coalesce(cwe, 'CWE-0') || ': ' || cast(count(*) as varchar) from f group by coalesce(cwe, 'CWE-0')"""


def _submission() -> str:
    one = "(select count(*) filter (sure) as a, count(*) filter (not sure) as b from g)"
    head = ["'# Vulnerability Submission'", "''", "'- **Date**: 2024-01-01'", "'- **Project**: p'", "'- **Category**: Web'", "'- **Verified**: ' || cast(a as varchar)", "'- **To be verified**: ' || cast(b as varchar)", "''", "'---'", "''", "'## Checklist'", "''"]
    head += [f"'- [ ] {item}'" for item in W.CHECKLIST] + ["''", "'---'", "''"]
    title, url = "'[x.example] ' || coalesce(title, 'Untitled')", "coalesce(url, 'x.example')"
    label = _LABEL.replace("case severity", "case coalesce(severity, 'low')")
    advice = "coalesce(remediation, case cwe when 'CWE-89' then 'Use parameterized queries / prepared statements. Never concatenate user input into SQL.' when 'CWE-79' then 'Use template auto-escaping. Sanitize user input with bleach or similar.' when 'CWE-22' then 'Use os.path.abspath + os.path.commonpath to validate paths. Never concatenate user input into file paths.' end, 'Review and fix the vulnerability.')"
    steps = f"case when k % 4 = 0 then '1. open it' || chr(10) || '1. see ' || cast(k as varchar) else '1. Open ' || {url} || chr(10) || '2. Look at the answer and the page''s source' || chr(10) || '3. Find what is described above' end"
    section = [
        f"'## ' || cast(place as varchar) || ': ' || {title}", "''", "'### Basics'", "''", "'| Item | Value |'", "'|------|------|'", _row("Title", title), _row("Category", "'Web'"), _row("Severity", label), _row("CWE", "coalesce(cwe, '?')"),
        _row("Confidence", "coalesce(cast(confidence as varchar), '?') || '%'"), _row("URL", url), "''", "'### Description'", "''", "coalesce(description, 'See the steps below')", "''", "'### Steps'", "''", steps, "''", "'### Proof'", "''",
        f"case when poc is not null then '```' || chr(10) || poc || chr(10) || '```' else '```' || chr(10) || 'curl -i ' || {url} || chr(10) || '```' end", "''", "'### Evidence'", "''", "case when evidence is not null then '```' || chr(10) || substr(evidence, 1, 500) || chr(10) || '```' end", "''",
        "'### Remediation'", "''", advice, "''", "'---'", "''",
    ]
    rest = ["cast(place as varchar) || '. ' || coalesce(title, '?') || ' (confidence: ' || coalesce(cast(confidence as varchar), '?') || '%)'"]
    placed = "(select *, row_number() over (order by seq) as place from g where {0} sure)"
    return f"with {_F}, g as (select *, verified or coalesce(confidence >= 80, false) as sure from f) {_lines(1, '0', head, one)} union all {_lines(2, 'place', section, placed.format(''))} union all {_lines(3, '0', [quoted('## To be verified'), quoted('')], one)} union all {_lines(4, 'place', rest, placed.format('not'))}"


def _pages() -> str:
    one = "(select count(*) as total from f)"
    head = ["'# Security Report'", "''", "'- **Target:** x.example'", "'- **Findings:** ' || cast(total as varchar)", "'- **Technologies:** Nginx'", "'- **Method:** passive, captured pages only'", "''", "'---'", "''"]
    category = "case category when 'api_leak' then 'API route leak' when 'info_leak' then 'Information leak' else category end"
    text = lambda c: f"coalesce({c}, '')"
    section = [
        f"'## [' || {_LABEL} || '] ' || title", "''", "'| Item | Value |'", "'|------|------|'", _row("Category", category), _row("Severity", _LABEL), _row("CWE", text("cwe")), _row("URL", text("url")), _row("Confidence", "coalesce(cast(confidence as varchar), '') || '%'"), "''",
        f"'**Description:** ' || {text('description')}", "''", "'**Evidence:**'", "'```'", "substr(coalesce(evidence, ''), 1, 500)", "'```'", "''", "'**How to verify:**'", "case when k % 4 = 0 then '  open it' || chr(10) || '  see ' || cast(k as varchar) else '' end", "''",
        f"'**Remediation:** ' || {text('remediation')}", "''", "'---'", "''",
    ]
    return f"with {_F}, shown as (select *, row_number() over (order by {_RANK}, seq) as place from f where severity is not null and {_RANK} is not null) {_lines(1, '0', head, one)} union all {_lines(2, 'place', section, 'shown')}"


def _templates_sql() -> str:
    text = "coalesce(description, '')"
    body = (
        "'# Vulnerability Report' || chr(10) || chr(10) || '## Basics' || chr(10) || '- **Title**: ' || coalesce(title, 'Untitled') || chr(10) || '- **CWE**: ' || coalesce(cwe, 'N/A') || chr(10) || '- **Severity**: ' || upper(coalesce(severity, 'medium')) || chr(10) || '- **Date**: 2024-01-01' || chr(10) || chr(10) || "
        f"'## Description' || chr(10) || substr({text}, 1, 2000) || chr(10) || chr(10) || '## Scope' || chr(10) || '- File: ' || case when hook_id < 30 then 'src/' || cast(hook_id as varchar) else 'unknown' end || chr(10) || '- Function: ' || case when hook_id < 30 then 'run' else 'unknown' end || chr(10) || chr(10) || "
        "'## Steps to reproduce' || chr(10) || '1. Find the place and review the code around it' || chr(10) || '2. Send input that reaches it' || chr(10) || '3. Observe the behavior' || chr(10) || chr(10) || '## Proof of Concept' || chr(10) || '```' || chr(10) || coalesce(poc, '# Write the proof by hand from the description') || chr(10) || '```' || chr(10) || chr(10) || "
        f"'## Remediation' || chr(10) || case when contains(lower({text}), 'fix') then {text} else '1. Use parameterized queries or an ORM' || chr(10) || '2. Validate and clean all user input' || chr(10) || '3. Grant least privilege' end || chr(10)"
    )
    return f"with {_F} select seq as finding_id, substr(regexp_replace(coalesce(title, 'Untitled'), '[^A-Za-z0-9 _-]', '', 'g'), 1, 40) || '.md' as file_name, {body} as text from f where verdict in ('true_positive', 'valid')"


def _scan() -> str:
    five = ["critical", "high", "medium", "low", "info"]
    head = '{"report_id": "j1", "timestamp": "now", "scan_type": "quick", "repo_url": "", "elapsed_sec": 0.0, "stats": {"files_scanned": 3, "total_hooks": 4, "total_findings": '
    counts = " || ', ' || ".join(f"'\"{s}\": ' || cast(count(*) filter (coalesce(severity, 'info') = '{s}') as varchar)" for s in five)
    out = f"with {_F} select cast(1 as int) as part, cast(0 as bigint) as seq, cast(0 as int) as n, '{head}' || cast(count(*) as varchar) || ', \"true_positives\": ' || cast(count(*) filter (verdict = 'true_positive') as varchar) || '}}, \"findings_by_severity\": {{' || {counts} || '}}, \"findings\": {{' as line from f"
    fields = "{'title': coalesce(title, 'Untitled'), 'cwe': coalesce(cwe, 'N/A'), 'confidence': coalesce(confidence, 0), 'description': substr(coalesce(description, ''), 1, 300), 'poc': substr(coalesce(poc, ''), 1, 500)}"
    for i, s in enumerate(five):
        out += f" union all select {2 + 3 * i}, 0, 0, '{',' if i else ''}\"{s}\": ['"
        out += f" union all select {3 + 3 * i}, place, 0, case when place > 1 then ',' else '' end || cast(to_json({fields}) as varchar) from (select *, row_number() over (order by seq) as place from f where coalesce(severity, 'info') = '{s}')"
        out += f" union all select {4 + 3 * i}, 0, 0, ']'"
    return out + " union all select 17, 0, 0, '}}'"


def _scored() -> str:
    """Snippets with the score of each pattern, from the patterns as they stand above."""
    words = ["execute", "cursor", "query", "select", "insert", "exec", "system", "popen", "subprocess", "eval", "open(", "file(", "os.", "request.", "input", "innerhtml", "render", "redirect"]
    suspected = "case hook_type when 'injection' then 'CWE-89' when 'command_exec' then 'CWE-78' when 'file_operation' then 'CWE-22' when 'route_entry' then 'CWE-862' when 'input_source' then 'CWE-79' end"
    table = values([(*p[:4], None if p[4] == "[" else p[4] or None, p[5]) for p in [(a, b, None if c == "(broken" else c or None, d, e, f) for a, b, c, d, e, f in PATTERNS]], "p", "pid, cwe, signature, code, rule, seen")
    hit = lambda c: f"coalesce(regexp_matches(snippet, {c}, 'i'), false)"
    shared = f"len([w for w in {_list(words)} if contains(lower(snippet), w) and contains(lower(code), w)])"
    snippets = keyed("documents", "doc_id", len(SNIPPETS), [(k, s, h) for k, (s, h, _) in enumerate(SNIPPETS)], "snippet, hook_type")
    return f"s as (select doc_id as id, coalesce(snippet, '') as snippet, hook_type, k from {snippets}), c as (select id, k, pid, seen, snippet, 3 * cast(coalesce(cwe = {suspected}, false) as int) + 5 * cast({hit('rule')} as int) + 4 * cast({hit('signature')} as int) + least(3, {shared}) as score from s, {table}), m as (select *, row_number() over (partition by id order by score desc, seen desc, pid) as rank from c where score > 0)"


def _retrieved() -> str:
    vectors = values([(pid, *(v or (None, None, None))) for pid, v in VECTORS.items()], "p", "pid, x, y, z")
    mine = values([(k, *(v or (None, None, None))) for k, (_, _, v) in enumerate(SNIPPETS)], "q", "k, a, b, c")
    cosine = "coalesce((a * x + b * y + c * z) / nullif(sqrt(a * a + b * b + c * c) * sqrt(x * x + y * y + z * z), 0), 0)"
    return f"""with {_scored()}, asked as (select * from s where length(trim(snippet)) >= 10),
l as (select k, pid, {cosine} as likeness, a is not null as has from {mine}, {vectors}), r as (select *, row_number() over (partition by k order by likeness desc, pid) as rk from l where has),
again as (select id, pid, row_number() over (partition by id order by score desc, seen desc, pid) as rk from (select id, k, pid, seen, score - 3 * cast(k = 7 and pid = 5 as int) as score from c) where score > 0 and k in (select k from l where not has)),
u as (select id, pid, rank as place from m where rank <= 3 and id in (select id from asked) union all select id, r.pid, 10 + rk from asked join r on asked.k = r.k where rk <= 3 and likeness > 0.3 union all select id, pid, 10 + rk from again where rk <= 3 and id in (select id from asked)),
d as (select id, pid, min(place) as place from u group by 1, 2), n as (select id, cast(row_number() over (partition by id order by place) as int) as rank, cast(pid as bigint) as pid from d) select * from n where rank <= 3"""


def oracle_sql() -> dict[str, str]:
    export = "{'cwe': coalesce(cwe, 'CWE-0'), 'severity': coalesce(severity, 'info'), 'title': coalesce(title, ''), 'description': coalesce(description, ''), 'file': coalesce(file_path, ''), 'line': coalesce(line_start, 0), 'confidence': coalesce(confidence, 50), 'poc': " + _PROOF + ", 'remediation': coalesce(remediation, ''), 'function': coalesce(func_name, '')}"
    auth = ["'## GET /p/' || cast(page_id as varchar)", "'- Size: ' || cast(length(html) as varchar) || 'b'", "'- Sensitive fields: [''userId'', ''token'']'", "'```'", "substr(html, 1, 20)", "'```'", "''"]
    bulk = "case cwe when 'CWE-89' then 'sql_injection' when 'CWE-79' then 'xss' when 'CWE-200' then 'info_leak' when 'CWE-22' then 'path_traversal' else 'unknown' end"
    return {
        "report_markdown": _markdown(),
        "report_json": f"with {_F}, p as (select *, row_number() over (order by seq) as place from f) select cast(place as bigint) as seq, case when place > 1 then ',' else '' end || cast(to_json({export}) as varchar) as line from p",
        "report_scan": _scan(),
        "report_submission": _submission(),
        "report_pages": _pages(),
        "report_auth": f"{_lines(1, '0', [quoted('# Auth Scan Report'), quoted(''), quoted('HAR: x.har'), quoted('Domain: x.example'), quoted('Findings: ') + ' || cast(total as varchar)', quoted('')], '(select count(*) as total from pages)')} union all {_lines(2, 'place', auth, '(select *, row_number() over (order by page_id) as place from pages)')}",
        "report_templates": _templates_sql(),
        "cwe_counts": f"with {_F} select coalesce(cwe, 'CWE-0') as cwe, count(*) as n from f group by 1",
        "pattern_extract": f"select doc_id as finding_id, pattern_type, code_signature, code as vulnerable_snippet, rule as detection_rule, fix as fix_snippet from {keyed('documents', 'doc_id', len(EXTRACTED), [(k, *e[3:], e[1] or '') for k, e in enumerate(EXTRACTED) if e[3]], 'pattern_type, code_signature, code, rule, fix')}",
        "pattern_bulk": f"with {_F} select seq as finding_id, {bulk} as pattern_type, coalesce(description, '') as vulnerable_snippet from f where verdict = 'true_positive' and cwe is not null",
        "pattern_match": f"with {_scored()} select id, cast(rank as int) as rank, cast(pid as bigint) as pid, cast(score as int) as score from m where rank <= 3",
        "pattern_retrieve": _retrieved(),
    }
