"""Queries over authored cases, each paired with rows of the driver's tables by key, and SQL that holds their hand-derived answers.

The tables hold prose, so every document (or page, event, ...) stands for one authored case. The SQL joins the same rows to
the answers of cases.py, which were derived by hand; it reads none of the library's rule tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import claims as C
from ..operators import hooks as H
from ..operators import pages as P
from . import cases


def quoted(x) -> str:
    """A Python value as SQL."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return repr(x)
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"


def values(rows: Iterable[tuple], name: str, columns: str) -> str:
    """A table of SQL, rows as they are."""
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") {name}({columns})"


def keyed(table: str, key: str, n: int, rows: Iterable[tuple], columns: str) -> str:
    """FROM: the rows of a driver's table, each with its case's rows; k is the case."""
    return f"{table} t join {values(rows, 'v', 'k, ' + columns)} on t.{key} % {n} = v.k"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def paired(rows: DataFrame, key: str, table: list[tuple], schema: str) -> DataFrame:
    """Each row's key as id, with one authored row; the authored table is small and broadcast."""
    authored = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(table)], f"k long, {schema}")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.select(F.col(key).alias("id"), (F.col(key) % len(table)).alias("k")).join(F.broadcast(authored), "k").select("id", "k", *names)


_HOOK = "language string, path string, func string, cwe string, severity string, snippet string, content string"


def hooks(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "documents"), "doc_id", [c[:7] for c in cases.HOOKS], _HOOK).withColumnRenamed("id", "doc_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return H.decide(hooks(spark, sf)).withColumn("confidence", H.confidence(F.col("fp_filtered"), F.col("severity"), F.col("snippet")))


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    """Kept hooks, classified, counted by severity."""
    return H.severity_summary(H.classify(scored(spark, sf).where("not fp_filtered")), "class_severity")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    kept = H.classify(scored(spark, sf).where("not fp_filtered")).withColumn("line_start", F.lit(1))
    return H.to_findings(kept.withColumn("path", F.concat_ws("/", F.col("doc_id").cast("string"), "path")))


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    files = paired(read(spark, sf, "documents"), "doc_id", [c[:2] for c in cases.SCANS], "language string, content string")
    return H.scan_lines(files.withColumn("path", F.col("id").cast("string")).drop("k")).select("id", "line_start", "cwe", "severity", "hook_type", "snippet")


def _claimed(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "documents"), "doc_id", [c[:2] for c in cases.CLAIMS], "path string, description string")


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(_claimed(spark, sf), spark.createDataFrame(cases.PROJECT, "path string, content string"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "documents"), "doc_id", [c[:1] for c in cases.ANSWERS], "raw string").withColumnRenamed("id", "hook_id")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "pages"), "page_id", [c[:1] for c in cases.PAGES], "html string")


_CAPTURE = "url string, path string, status int, body string"


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    return paired(read(spark, sf, "pages"), "page_id", [c[:4] for c in cases.CAPTURES], _CAPTURE)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    c = _captures(spark, sf)
    return c.select(
        "id", P.exposure(F.col("path"), F.col("status")).alias("exposure"), P.live(F.col("status"), F.length("body"), F.lit(4)).alias("live"),
        P.leak_confidence(F.col("status"), F.col("body")).alias("leak"), F.array_join(P.resource_ids(F.col("body")), ",").alias("ids"),
    )


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return P.endpoint_findings(_captures(spark, sf)).select("url", "severity", "cwe", "title", "evidence", "confidence")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return P.info_leaks(_captures(spark, sf)).groupBy("url", "path", "severity", "cwe", "title", "evidence").agg(F.count("*").alias("n"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.classify(hooks(spark, sf)).withColumn("line_start", F.lit(1))
    return H.cwe_stats(rows, F.col("doc_id")).groupBy("class_cwe", "n", "first_title", "path").agg(F.count("*").alias("places"))


#: An architect's answer; the hooks it proposes: path, function, type, language, reason.
PROPOSED = [
    ('{"hooks": [{"file_path": "a.py", "function_name": "f", "hook_type": "injection", "risk_reason": "r"}, {"file_path": "b/c.GO"}]}', [("a.py", "f", "injection", "python", "r"), ("b/c.GO", "unknown", "unknown", "go", "")]),
    ('```json\n{"hooks": [{"function_name": "g", "risk_reason": "s"}]}\n``` FINAL_RESULT', [("", "g", "unknown", "unknown", "s")]),
    ('{"hooks": []}', []), ("nothing", []), (None, []),
]


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    raw = paired(read(spark, sf, "documents"), "doc_id", [p[:1] for p in PROPOSED], "raw string")
    return A.proposed_hooks(raw).select("id", "hook_id", "file_path", "func_name", "hook_type", "language", F.col("snippet").alias("reason"), "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "hook_flow": _flow,
        "fp_decisions": lambda s, d: H.decide(hooks(s, d)).select("doc_id", "fp_filtered", "fp_reason"),
        "cwe_classify": lambda s, d: H.classify(hooks(s, d)).select("doc_id", "class_cwe", "class_title", "class_severity", "remediation"),
        "confidence_score": lambda s, d: scored(s, d).select("doc_id", "confidence"),
        "compliance": lambda s, d: H.comply(scored(s, d)).select("doc_id", "low_impact", "platform_severity", "submittable"),
        "hook_findings": lambda s, d: _findings(s, d).select("title", "severity", "cwe", "confidence", "file_path", "verdict"),
        "cwe_stats": _stats,
        "proposed_hooks": _proposed,
        "hooks_grep_scan": _scans,
        "halluc_issues": lambda s, d: _issues(s, d).groupBy("id", "check", "severity").agg(F.sum("n").alias("n")),
        "halluc_score": lambda s, d: C.verdicts(_claimed(s, d), _issues(s, d)),
        "auditor_outcomes": lambda s, d: A.outcomes(_answers(s, d)).select("hook_id", "status", "confidence", "verdict", "severity", "title", "cwe_id"),
        "tech_fingerprint": lambda s, d: _pages(s, d).select("id", F.array_join(P.technologies(F.col("html")), ",").alias("found")),
        "api_routes": lambda s, d: _pages(s, d).select("id", F.array_join(P.api_routes(F.col("html")), "|").alias("routes")),
        "page_secrets": lambda s, d: _pages(s, d).select("id", F.posexplode(P.secrets(F.col("html"))).alias("place", "s")).select("id", "place", "s.type", "s.length"),
        "captured_answers": _judged,
        "endpoint_exposure": _sites,
        "info_leaks": _leaks,
    }


_N = len(cases.HOOKS)
_ADVICE = {
    "CWE-89": "Use parameterized queries / prepared statements. Never concatenate user input into SQL.", "CWE-78": "Use subprocess with shell=False and a list of arguments. Avoid os.system().",
    "CWE-94": "Never pass user-controlled data to eval/exec. Use ast.literal_eval() if needed.", "CWE-502": "Never unpickle/unmarshal untrusted data. Use JSON or a safe serialization format.",
    "CWE-22": "Use os.path.abspath + os.path.commonpath to validate paths. Never concatenate user input into file paths.", "CWE-918": "Whitelist allowed URLs/hosts. Never let users control the full URL.",
    "CWE-79": "Use template auto-escaping. Sanitize user input with bleach or similar.", "CWE-798": "Use environment variables or a secrets manager. Never commit credentials to source code.",
    "CWE-611": "Disable external entity processing in XML parsers. Set resolve_entities=False.", "CWE-601": "Use django.utils.http.url_has_allowed_host_and_scheme() or equivalent.",
    "CWE-917": "Avoid JNDI lookups with user-controlled names.", "CWE-98": "Use a whitelist of allowed files. Never include files based on user input.", "CWE-0": None,
}
_LOWER = {"critical": "high", "high": "medium", "medium": "low", "low": "info", "info": "info", None: None}


def _complies(case: tuple) -> tuple:
    """Of a case: low impact, severity after it, whether it can be handed in."""
    cwe, severity, points = case[3], case[4], case[11]
    low = cwe in ("CWE-200", "CWE-532", "CWE-209", "CWE-798", "CWE-204", "CWE-548", "CWE-693")
    severity = _LOWER[severity] if low else severity
    return low, severity, not low and severity in ("critical", "high", "medium") and points >= 60


def _finding(case: tuple) -> tuple:
    """Of a kept case: title, severity, class, points, path."""
    title = case[9] or (case[8] if case[8] != "CWE-0" else "?")
    return f"{case[8]}: {title} in {'?' if case[2] is None else case[2]}()", case[10] or "info", case[8], case[11], case[1]


def _case_rows(table: list[tuple], of: Callable[[tuple], Iterable[tuple]]) -> list[tuple]:
    return [(k, *row) for k, case in enumerate(table) for row in of(case)]


def oracle_sql() -> dict[str, str]:
    hook = lambda of, columns: keyed("documents", "doc_id", _N, _case_rows(cases.HOOKS, of), columns)
    claim = lambda of, columns: keyed("documents", "doc_id", len(cases.CLAIMS), _case_rows(cases.CLAIMS, of), columns)
    page = lambda of, columns: keyed("pages", "page_id", len(cases.PAGES), _case_rows(cases.PAGES, of), columns)
    capture = lambda of, columns: keyed("pages", "page_id", len(cases.CAPTURES), _case_rows(cases.CAPTURES, of), columns)
    counts: dict[tuple, dict[tuple, int]] = {}
    for k, case in enumerate(cases.CLAIMS):
        for check, severity, n in case[2]:
            counts.setdefault(k, {})[check, severity] = counts.get(k, {}).get((check, severity), 0) + n
    levels = values([(s, i) for i, s in enumerate(("critical", "high", "medium", "low", "info"))], "e", "severity, ord")
    return {
        "hook_flow": f"with c as (select v.s as severity, count(*) as n from {hook(lambda c: [(c[10],)] if c[7] is None else [], 's')} group by 1) select e.severity, cast(ord as int) as ord, coalesce(n, 0) as n from {levels} left join c on e.severity = c.severity",
        "fp_decisions": f"select doc_id, reason is not null as fp_filtered, reason as fp_reason from {hook(lambda c: [(c[7],)], 'reason')}",
        "cwe_classify": f"select doc_id, cwe as class_cwe, title as class_title, sev as class_severity, remediation from {hook(lambda c: [(c[8], c[9], c[10], _ADVICE.get(c[8], 'Review and fix the vulnerability.'))], 'cwe, title, sev, remediation')}",
        "confidence_score": f"select doc_id, cast(points as int) as confidence from {hook(lambda c: [(c[11],)], 'points')}",
        "compliance": f"select doc_id, low_impact, platform_severity, submittable from {hook(lambda c: [_complies(c)], 'low_impact, platform_severity, submittable')}",
        "hook_findings": f"select title, sev as severity, cwe, cast(points as int) as confidence, cast(doc_id as varchar) || '/' || p as file_path, 'unreviewed' as verdict from {hook(lambda c: [_finding(c)] if c[7] is None else [], 'title, sev, cwe, points, p')}",
        "cwe_stats": f"with c as (select doc_id, cwe, title, p from {hook(lambda c: [(c[8], c[9], c[1])], 'cwe, title, p')}), g as (select cwe, count(*) as n, list(title order by doc_id)[1] as first_title from c group by 1) select c.cwe as class_cwe, n, first_title, p as path, count(*) as places from c join g on c.cwe = g.cwe group by all",
        "proposed_hooks": f"select doc_id as id, substr(sha256(p || ':' || f || ':0'), 1, 16) as hook_id, p as file_path, f as func_name, kind as hook_type, l as language, reason, 'pending' as status from {keyed('documents', 'doc_id', len(PROPOSED), _case_rows(PROPOSED, lambda c: c[1]), 'p, f, kind, l, reason')}",
        "hooks_grep_scan": f"select doc_id as id, cast(line as int) as line_start, cwe, severity, hook_type, snippet from {keyed('documents', 'doc_id', len(cases.SCANS), _case_rows(cases.SCANS, lambda c: c[2]), 'line, cwe, severity, hook_type, snippet')}",
        "halluc_issues": f"select doc_id as id, cast(chk as int) as \"check\", severity, cast(n as bigint) as n from {keyed('documents', 'doc_id', len(cases.CLAIMS), [(k, *key, n) for k, rows in counts.items() for key, n in rows.items()], 'chk, severity, n')}",
        "halluc_score": f"select doc_id as id, cast(5 as int) as checks_run, cast(p as int) as checks_passed, ok as passed, cast(penalty as double) as penalty, cast(boost as double) as boost from {claim(lambda c: [c[3:7]], 'p, ok, penalty, boost')}",
        "auditor_outcomes": f"select doc_id as hook_id, status, cast(confidence as double) as confidence, verdict, severity, title, cwe_id from {keyed('documents', 'doc_id', len(cases.ANSWERS), _case_rows(cases.ANSWERS, lambda c: [c[1:]]), 'status, confidence, verdict, severity, title, cwe_id')}",
        "tech_fingerprint": f"select page_id as id, found from {page(lambda c: [(','.join(c[1]),)], 'found')}",
        "api_routes": f"select page_id as id, routes from {page(lambda c: [(c[2],)], 'routes')}",
        "page_secrets": f"select page_id as id, cast(place as int) as place, type, cast(length as int) as length from {page(lambda c: [(i, *s) for i, s in enumerate(c[3])], 'place, type, length')}",
        "captured_answers": f"select page_id as id, exposure, live, cast(leak as int) as leak, ids from {capture(lambda c: [c[4:8]], 'exposure, live, leak, ids')}",
        "endpoint_exposure": "select * from "
        + values(
            [
                ("https://a.example", "high", "CWE-538", "Sensitive File Exposure (1 endpoint(s))", "/.env", 80),
                ("https://a.example", "medium", "CWE-200", "Development Endpoint Exposure (2 endpoint(s))", "/actuator/health\n/swagger-ui.html", 65),
            ], "v", "url, severity, cwe, title, evidence, confidence",
        ),
        "info_leaks": "select v.url, v.path, v.severity, cwe, title, evidence, count(*) as n from "
        + keyed(
            "pages", "page_id", len(cases.CAPTURES),
            [(11, "https://b.example", "/robots.txt", "low", "CWE-200", "Robots.txt Reveals 3 Hidden Paths", "/a\n/b\n/c"), (13, "https://c.example", "/crossdomain.xml", "low", "CWE-942", "Permissive /crossdomain.xml Policy", "")],
            "url, path, severity, cwe, title, evidence",
        ) + " group by all",
    }
