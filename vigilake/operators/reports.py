"""Reports as rows of lines: (part, seq, n, line). Sorted by these they are a report, whatever its length; nothing is collected.

Parts are numbered in the report's order, seq is the finding's place in its part and n the line of that. write_lines()
sorts the rows into text files whose names follow that order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .hooks import remediation
from .order import numbered

LINES = ["part", "seq", "n", "line"]
PLATFORMS = {"butian": "补天SRC", "hackerone": "HackerOne", "tsrc": "腾讯TSRC", "360src": "360SRC"}
SHOWN = ["critical", "high", "medium", "low"]
LABELS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}


def _text(name: str | Column, other: str = "") -> Column:
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit(other))


def _fixed(rows: DataFrame, part: int, lines: list[Column | str]) -> DataFrame:
    """Lines of a part that stands once; rows has one row."""
    return rows.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.posexplode(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])).alias("n", "line"))


def _each(rows: DataFrame, part: int, place: str, lines: list[Column | str]) -> DataFrame:
    """Lines of every row, at its place; a null line is left out."""
    every = F.filter(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines]), lambda x: x.isNotNull())
    return rows.select(F.lit(part).alias("part"), F.col(place).cast("long").alias("seq"), F.posexplode(every).alias("n", "line"))


def _count(rows: DataFrame, **more: Column) -> DataFrame:
    return rows.agg(F.count("*").cast("string").alias("n_all"), *[c.alias(k) for k, c in more.items()])


def severity_rank(severity: Column, other: int = 9) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, R.SEVERITIES)), severity), F.lit(0).cast("long")), F.lit(other)).cast("long")


def danger_line(snippet: Column) -> Column:
    """The marked line of a snippet without its mark, else the first 200 letters."""
    marked = F.try_element_at(F.filter(F.split(snippet, "\n"), lambda x: F.contains(x, F.lit(">>>"))), F.lit(1))
    return F.coalesce(F.trim(F.replace(marked, F.lit(">>>"), F.lit(""))), F.substring(snippet, 1, 200))


#: What a finding's section says about its class, above the code it stands in. Advice only.
PROOF_TITLES = {
    "CWE-89": "SQL Injection", "CWE-78": "Command Injection", "CWE-22": "Path Traversal", "CWE-94": "Code Injection", "CWE-502": "Deserialization", "CWE-918": "SSRF",
    "CWE-79": "XSS", "CWE-798": "Hardcoded Credentials", "CWE-601": "Open Redirect", "CWE-611": "XXE",
}


def proof(cwe: Column, snippet: Column) -> Column:
    """The class of a finding, the code it stands in, and that someone has to verify it."""
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PROOF_TITLES.items() for x in pair]), cwe), F.lit("Finding"))
    return F.concat(title, F.lit("\n\nVulnerable code:\n```\n"), _text(danger_line(snippet)), F.lit("\n```\n\nManual verification required."))


def in_order(findings: DataFrame, seq: str, place: str = "_place") -> DataFrame:
    """Findings of shown severities (none counts as medium) with their place by severity, then arrival."""
    rank = severity_rank(F.coalesce("severity", F.lit("medium")))
    rows = findings.withColumn("_rank", rank).where(F.col("_rank") <= len(SHOWN))
    return numbered(rows, ["_rank", seq], place).drop("_rank")


def markdown_report(findings: DataFrame, seq: str, platform: str = "butian", target: str = "", generated: str = "") -> DataFrame:
    """findings (seq, severity, cwe, title, description, confidence, remediation, file_path, snippet): the lines of a report for a platform.

    A head with the number of all findings, sections by severity (critical to low, arrival order inside), and the number
    of findings of each class, in text order.
    """
    name = PLATFORMS.get(platform, PLATFORMS["butian"])
    head = ["# Security Audit Report", "", f"- Platform: {name}", f"- Generated: {generated}", f"- Target: {target}", F.concat(F.lit("- Total Findings: "), "n_all"), "", "---", ""]
    severity, cwe = _text("severity", "medium"), _text("cwe", "CWE-0")
    row = lambda label, value: F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))
    section = [
        F.concat(F.lit("## #"), F.col("_place").cast("string"), F.lit(" ["), F.upper(severity), F.lit("] "), cwe, F.lit(": "), _text("title", "Untitled")), "", "| Field | Value |", "|-------|-------|",
        row("CWE", cwe), row("Severity", severity), row("Location", _text("file_path")), row("Confidence", F.concat(_text("confidence", "50"), F.lit("%"))), row("Description", _text("description")),
        row("Remediation", _text("remediation", "Review and fix")), "", proof(F.col("cwe"), _text("snippet")), "", "---", "",
    ]
    by_class = findings.groupBy(cwe.alias("cwe")).agg(F.count("*").alias("k"))
    tail = by_class.select(F.lit(4).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("n"), F.concat(F.lit("- "), "cwe", F.lit(": "), F.col("k").cast("string")).alias("line"))
    return _fixed(_count(findings), 1, head).unionByName(_each(in_order(findings, seq), 2, "_place", section)).unionByName(_fixed(_count(findings), 3, ["## Summary", ""])).unionByName(tail)


def cwe_counts(findings: DataFrame) -> DataFrame:
    """cwe, n of every class, CWE-0 for none; order them by cwe as text where they are shown."""
    return findings.groupBy(_text("cwe", "CWE-0").alias("cwe")).agg(F.count("*").alias("n"))


def _json_rows(rows: DataFrame, part: int, place: str, fields: dict[str, Column]) -> DataFrame:
    """One line for each row, a JSON object; all but the first begin with a comma."""
    line = F.concat(F.when(F.col(place) > 1, ",").otherwise(""), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}))
    return rows.select(F.lit(part).alias("part"), F.col(place).cast("long").alias("seq"), F.lit(0).alias("n"), line.alias("line"))


def json_export(findings: DataFrame, seq: str, version: str = "", generated: str = "") -> DataFrame:
    """findings (seq, cwe, severity, title, description, file_path, line_start, confidence, remediation, func_name, snippet): the lines of one JSON document with all of them, in arrival order."""
    meta = F.concat(F.lit(f'{{"meta":{{"version":{json.dumps(version)},"timestamp":{json.dumps(generated)},"total_findings":'), "n_all", F.lit('},"findings":['))
    fields = {
        "cwe": _text("cwe", "CWE-0"), "severity": _text("severity", "info"), "title": _text("title"), "description": _text("description"), "file": _text("file_path"), "line": F.coalesce("line_start", F.lit(0)),
        "confidence": F.coalesce("confidence", F.lit(50)), "poc": proof(F.col("cwe"), _text("snippet")), "remediation": _text("remediation"), "function": _text("func_name"),
    }
    return _fixed(_count(findings), 1, [meta]).unionByName(_json_rows(numbered(findings, seq, "_place"), 2, "_place", fields)).unionByName(_fixed(_count(findings), 3, ["]}"]))


def scan_report(findings: DataFrame, seq: str, job: str, stats: dict[str, int], scan_type: str = "quick", target: str = "", elapsed: float = 0.0, generated: str = "") -> DataFrame:
    """findings (seq, severity, title, cwe, confidence, description, poc, verdict): the lines of one JSON document: counts, then findings by severity.

    A severity that is none of the five is counted in the total and listed nowhere; none at all counts as info.
    """
    severity = F.coalesce("severity", F.lit("info"))
    tally = findings.agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "true_positive").alias("real"), *[F.count_if(severity == s).alias(s) for s in R.SEVERITIES])
    head = {"report_id": job, "timestamp": generated, "scan_type": scan_type, "repo_url": target, "elapsed_sec": round(elapsed, 1)}
    text = lambda c: F.col(c).cast("string")
    known = [F.lit(json.dumps(head)[:-1] + f', "stats": {{"files_scanned": {stats.get("files_scanned", 0)}, "total_hooks": {stats.get("hooks_total", 0)}, "total_findings": '), text("total"), F.lit(', "true_positives": '), text("real"), F.lit('}, "findings_by_severity": {')]
    counts = [F.concat(F.lit(f'"{s}": '), text(s)) for s in R.SEVERITIES]
    out = _fixed(tally, 1, [F.concat(*known, F.concat_ws(", ", *counts), F.lit('}, "findings": {'))])
    rows = numbered(findings.withColumn("_sev", severity).where(F.col("_sev").isin(R.SEVERITIES)), seq, "_place", group=["_sev"])
    fields = {
        "title": _text("title", "Untitled"), "cwe": F.coalesce(F.nullif(F.col("cwe"), F.lit("")), F.lit("N/A")), "confidence": F.coalesce("confidence", F.lit(0)),
        "description": F.substring(_text("description"), 1, 300), "poc": F.substring(_text("poc"), 1, 500),
    }
    for i, s in enumerate(R.SEVERITIES):
        out = out.unionByName(_fixed(tally, 2 + 3 * i, [f'{"," if i else ""}"{s}": [']))
        out = out.unionByName(_json_rows(rows.where(F.col("_sev") == s), 3 + 3 * i, "_place", fields)).unionByName(_fixed(tally, 4 + 3 * i, ["]"]))
    return out.unionByName(_fixed(tally, 2 + 3 * len(R.SEVERITIES), ["}}"]))


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that are verified or have 80 points, and all others."""
    sure = F.coalesce(F.col("verified"), F.lit(False)) | F.coalesce(F.col("confidence") >= 80, F.lit(False))
    return findings.where(sure), findings.where(~sure)


CHECKLIST = ["Local test records are deleted", "No test data is kept or passed on", "The details hold all steps to reproduce", "The proof was checked by hand", "Attachments are one ZIP file"]


def submission_report(findings: DataFrame, seq: str, domain: str, project: str = "", date: str = "") -> DataFrame:
    """findings (seq, verified, confidence, severity, title, cwe, url, description, steps array, poc, evidence, remediation): the lines of a report to hand in.

    A checklist, a section for each verified finding, and a numbered list of the others.
    """
    sure, open_ = (numbered(rows, seq, "_place") for rows in split(findings))
    both = _count(sure, n_sure=F.count("*").cast("string")).crossJoin(_count(open_).withColumnRenamed("n_all", "n_open"))  # one row each
    head = ["# Vulnerability Submission", "", f"- **Date**: {date}", f"- **Project**: {project or domain}", "- **Category**: Web", F.concat(F.lit("- **Verified**: "), "n_sure"), F.concat(F.lit("- **To be verified**: "), "n_open"), "", "---", "", "## Checklist", ""]
    head += [f"- [ ] {item}" for item in CHECKLIST] + ["", "---", ""]
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.coalesce("severity", F.lit("low"))), F.col("severity"))
    title, url = F.concat(F.lit(f"[{domain}] "), _text("title", "Untitled")), _text("url", domain)
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    steps = F.when(F.size("steps") > 0, F.array_join(F.transform("steps", lambda s: F.concat(F.lit("1. "), s)), "\n")).otherwise(F.concat(F.lit("1. Open "), url, F.lit("\n2. Look at the answer and the page's source\n3. Find what is described above")))
    code = F.when(_text("poc") != "", F.concat(F.lit("```\n"), "poc", F.lit("\n```"))).otherwise(F.concat(F.lit("```\ncurl -i "), url, F.lit("\n```")))
    evidence = F.when(_text("evidence") != "", F.concat(F.lit("```\n"), F.substring("evidence", 1, 500), F.lit("\n```")))
    section = [
        F.concat(F.lit("## "), F.col("_place").cast("string"), F.lit(": "), title), "", "### Basics", "", "| Item | Value |", "|------|------|", row("Title", title), row("Category", F.lit("Web")), row("Severity", label),
        row("CWE", _text("cwe", "?")), row("Confidence", F.concat(_text("confidence", "?"), F.lit("%"))), row("URL", url), "", "### Description", "", _text("description", "See the steps below"), "", "### Steps", "", steps, "",
        "### Proof", "", code, "", "### Evidence", "", evidence, "", "### Remediation", "", F.coalesce("remediation", remediation(F.col("cwe")), F.lit(R.REMEDIATION_ELSE)), "", "---", "",
    ]
    rest = F.concat(F.col("_place").cast("string"), F.lit(". "), _text("title", "?"), F.lit(" (confidence: "), _text("confidence", "?"), F.lit("%)"))
    out = _fixed(both, 1, head).unionByName(_each(sure, 2, "_place", section))
    return out.unionByName(_fixed(both.where("n_open <> '0'"), 3, ["## To be verified", ""])).unionByName(_each(open_, 4, "_place", [rest]))


CATEGORIES = {
    "api_leak": "API route leak", "secret_leak": "Hardcoded secret", "subdomain_leak": "Subdomain leak", "security_header": "Missing security header",
    "cookie_security": "Insecure cookie", "cors_misconfig": "CORS misconfiguration", "endpoint_exposure": "Exposed endpoint", "info_leak": "Information leak",
}


def page_report(findings: DataFrame, seq: str, target: str, technologies: str = "") -> DataFrame:
    """findings (seq, severity, category, title, cwe, url, confidence, description, evidence, steps array, remediation): the lines of a report on captured pages, by severity."""
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), F.col("category")), F.col("category"))
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("severity"))
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    some = _count(findings)
    head = ["# Security Report", "", f"- **Target:** {target}", F.concat(F.lit("- **Findings:** "), "n_all"), f"- **Technologies:** {technologies}", "- **Method:** passive, captured pages only", "", "---", ""]
    section = [
        F.concat(F.lit("## ["), label, F.lit("] "), "title"), "", "| Item | Value |", "|------|------|", row("Category", category), row("Severity", label), row("CWE", _text("cwe")), row("URL", _text("url")),
        row("Confidence", F.concat(_text("confidence"), F.lit("%"))), "", F.concat(F.lit("**Description:** "), _text("description")), "", "**Evidence:**", "```", F.substring(_text("evidence"), 1, 500), "```", "",
        "**How to verify:**", F.array_join(F.transform("steps", lambda s: F.concat(F.lit("  "), s)), "\n"), "", F.concat(F.lit("**Remediation:** "), _text("remediation")), "", "---", "",
    ]
    shown = in_order(findings.where(F.col("severity").isNotNull()), seq)
    nothing = _fixed(some.where("n_all = '0'"), 1, ["# Security Report", "", "No findings."])
    return nothing.unionByName(_fixed(some.where("n_all <> '0'"), 1, head)).unionByName(_each(shown, 2, "_place", section))


def auth_report(findings: DataFrame, seq: str, source: str, domain: str) -> DataFrame:
    """findings (seq, method, path, size, fields array, preview): the lines of a report on answers that hold user data."""
    head = ["# Auth Scan Report", "", f"HAR: {source}", f"Domain: {domain}", F.concat(F.lit("Findings: "), "n_all"), ""]
    shown = F.concat(F.lit("["), F.array_join(F.transform("fields", lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    section = [F.concat(F.lit("## "), _text("method", "?"), F.lit(" "), _text("path", "?")), F.concat(F.lit("- Size: "), _text("size", "0"), F.lit("b")), F.concat(F.lit("- Sensitive fields: "), shown), "```", _text("preview"), "```", ""]
    return _fixed(_count(findings), 1, head).unionByName(_each(numbered(findings, seq, "_place"), 2, "_place", section))


#: Headings of the templates: report, facts, description, where, steps, proof, fix.
TEMPLATES = {
    "general": ("Vulnerability Report", "Basics", "Description", "Scope", "Steps to reproduce", "Proof of Concept", "Remediation"),
    "tsrc": ("Security Response Center Report", "Summary", "Details", "Affected business", "Environment and steps", "PoC code", "Fix"),
    "360src": ("Security Response Center Report", "Information", "Detailed description", "Location", "Evidence of reproduction", "PoC", "Advice"),
    "butian": ("Platform Submission", "Overview", "Impact", "Location", "Steps in detail", "Complete PoC", "Fix"),
}
NO_PROOF = "# Write the proof by hand from the description"
GENERAL_FIX = "1. Use parameterized queries or an ORM\n2. Validate and clean all user input\n3. Grant least privilege"


def template_reports(findings: DataFrame, hooks: DataFrame, template: str = "general", date: str = "") -> DataFrame:
    """findings (finding_id, hook_id, verdict, title, cwe, severity, description, poc) and hooks (hook_id, file_path, func_name): finding_id, file_name, text.

    Only findings found real (true_positive or valid). hooks has one row for each id. Description and proof are cut at
    2,000 letters, the fix at 1,000; a description that speaks of a fix is the fix.
    """
    report, facts, about, where, steps, proof_, fix_ = TEMPLATES.get(template, TEMPLATES["general"])
    rows = findings.where(F.col("verdict").isin("true_positive", "valid")).join(hooks.select("hook_id", F.col("file_path").alias("_file"), F.col("func_name").alias("_func")), "hook_id", "left")
    text = _text("description")
    poc = F.when(_text("poc") != "", F.col("poc")).otherwise(NO_PROOF)
    fix = F.when(F.lower(text).contains("fix") | text.contains("修复"), text).otherwise(GENERAL_FIX)
    title = _text("title", "Untitled")
    body = F.concat(
        F.lit(f"# {report}\n\n## {facts}\n- **Title**: "), title, F.lit("\n- **CWE**: "), _text("cwe", "N/A"), F.lit("\n- **Severity**: "), F.upper(_text("severity", "medium")), F.lit(f"\n- **Date**: {date}\n\n## {about}\n"),
        F.substring(text, 1, 2000), F.lit(f"\n\n## {where}\n- File: "), _text("_file", "unknown"), F.lit("\n- Function: "), _text("_func", "unknown"),
        F.lit(f"\n\n## {steps}\n1. Find the place and review the code around it\n2. Send input that reaches it\n3. Observe the behavior\n\n## {proof_}\n```\n"),
        F.substring(F.trim(poc), 1, 2000), F.lit(f"\n```\n\n## {fix_}\n"), F.substring(fix, 1, 1000), F.lit("\n"),
    )
    return rows.select("finding_id", file_name(title).alias("file_name"), body.alias("text"))


def file_name(title: Column) -> Column:
    """A title's letters, digits, spaces, _ and -, at most 40, as the name of a Markdown file."""
    return F.concat(F.substring(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), 1, 40), F.lit(".md"))


def report_rows(findings: DataFrame) -> DataFrame:
    """findings (cwe, severity, title, path, line) as one line of Markdown each; sort them by rank and seq when written."""
    rank = severity_rank(F.col("severity"), 0)
    line = F.format_string("- **%s** %s: %s (`%s:%d`)", F.upper("severity"), F.coalesce("cwe", F.lit("CWE-0")), "title", "path", "line")
    return findings.withColumns({"rank": rank, "markdown": line}).where(f"rank between 1 and {len(SHOWN)}")


def write_lines(lines: DataFrame, path: str) -> None:
    """The report as text files; read in the order of their names they are the report."""
    lines.orderBy("part", "seq", "n", "line").select("line").write.text(path)


def report_list(spark, folder: str) -> DataFrame:
    """JSON reports in a folder, newest file first: path, report_id, timestamp, target, total."""
    schema = "report_id string, timestamp string, repo_url string, stats struct<total_findings:bigint>"
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).select("*", "_metadata.file_path", "_metadata.file_modification_time")
    return rows.select(F.col("file_path").alias("path"), "report_id", "timestamp", F.col("repo_url").alias("target"), F.col("stats.total_findings").alias("total"), "file_modification_time").orderBy(F.desc("file_modification_time"), "path")
