"""Hooks: line scan by rules, false-positive decision, classification, confidence, compliance.

Everything is a column expression or a join with a small rule table, so a scan of any size stays one stage until it
is aggregated. Regular expressions ignore case with (?iu), as the rules mean it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def _by_language(table: dict[str, list[str]], text: Column, flags: str = "(?iu)") -> Column:
    out = F.lit(False)
    for language, patterns in table.items():
        out = F.when(F.col("language") == language, text.rlike(flags + R.either(patterns))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def language_of(path: Column) -> Column:
    """By the path's lower-cased ending; null if it is none of ours."""
    names = F.create_map(*[F.lit(x) for pair in R.LANGUAGES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    base, folder = F.substring_index(low, "/", -1), F.regexp_replace(low, r"/?[^/]*$", "")
    return F.exists(F.array(*map(F.lit, R.TEST_MARKS)), lambda m: F.contains(base, m) | F.contains(folder, m))


def is_route(func: Column) -> Column:
    named = func.isNotNull() & (func != "")
    return F.coalesce(named & F.when(F.col("language") == "python", func.rlike(R.ROUTES["python"])).when(F.col("language") == "java", func.rlike(R.ROUTES["java"])).otherwise(False), F.lit(False))


def safe_reason() -> Column:
    """Why a snippet is known to be safe; null if it is not."""
    out = F.lit(None).cast("string")
    for language, rows in R.SAFE.items():
        first = F.lit(None).cast("string")
        for pattern, reason in reversed(rows):
            first = F.when(F.col("snippet").rlike("(?iu)" + pattern), reason).otherwise(first)
        out = F.when(F.col("language") == language, first).otherwise(out)
    return out


def decide(hooks: DataFrame) -> DataFrame:
    """hooks (language, path, func, cwe, snippet, content) with fp_filtered and fp_reason, by the first rule that applies.

    Nulls count as empty texts; a null language has no rules. Every row gives one row.
    """
    snippet = F.col("snippet")
    fed = (F.coalesce("func", F.lit("")) != "") & _by_language(R.USER_INPUT, F.col("content"))
    reached = fed | is_route(F.col("func"))
    answer = lambda drop, why: F.struct(F.lit(drop).alias("fp_filtered"), (why if isinstance(why, Column) else F.lit(why)).cast("string").alias("fp_reason"))
    rule = (
        F.when(is_test_file(F.col("path")), answer(True, "Test file"))
        .when(F.coalesce(F.col("cwe").isin("CWE-78", "CWE-94", "CWE-89"), F.lit(False)) & ~_by_language(R.TAINT, snippet, ""), answer(True, F.concat("cwe", F.lit(": no user-controlled parameter detected"))))
        .when(_by_language(R.ALWAYS_TRUE, snippet), answer(False, None))
        .when((F.col("cwe") == "CWE-918") & reached, answer(False, None))
        .when(F.col("cwe") == "CWE-918", answer(True, "HTTP client call without user-controlled URL — not SSRF"))
        .when(safe_reason().isNotNull(), answer(True, safe_reason()))
        .when(reached, answer(False, None))
        .otherwise(answer(True, F.concat(F.lit("No user input reachable in function '"), F.coalesce("func", F.lit("")), F.lit("'"))))
    )
    return hooks.withColumn("_fp", rule).select(*hooks.columns, "_fp.fp_filtered", "_fp.fp_reason")


def column_or_null(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def remediation(cwe: Column) -> Column:
    """Advice for a class; a general one for classes without their own, none for null."""
    advice = F.create_map(*[F.lit(x) for pair in R.REMEDIATION.items() for x in pair])
    return F.when(cwe.isNotNull(), F.coalesce(F.try_element_at(advice, cwe), F.lit(R.REMEDIATION_ELSE)))


def classify(hooks: DataFrame) -> DataFrame:
    """hooks (language, snippet, and if known cwe, cwe_title, severity, hook_type) with class_cwe, class_title, class_severity, class_type and remediation.

    A class known before stays and becomes the type; only advice is added. Else the first rule of the language that the
    snippet matches; else CWE-0, without advice, type and severity as they were. An empty or null class is not known.
    """
    made = lambda c, t, s, k: F.struct(c.alias("class_cwe"), t.cast("string").alias("class_title"), s.cast("string").alias("class_severity"), k.alias("class_type"))
    had = {n: column_or_null(hooks, n) for n in ("cwe", "cwe_title", "severity", "hook_type")}
    nothing = made(F.lit("CWE-0"), F.lit(R.UNCLASSIFIED), had["severity"], had["hook_type"])
    rule = nothing
    for language, rows in R.CWE_RULES.items():
        first = nothing
        for pattern, cwe, title, severity in reversed(rows):
            first = F.when(F.col("snippet").rlike("(?iu)" + pattern), made(F.lit(cwe), F.lit(title), F.lit(severity), F.lit(cwe))).otherwise(first)
        rule = F.when(F.col("language") == language, first).otherwise(rule)
    known = F.coalesce((had["cwe"] != "") & (had["cwe"] != "CWE-0"), F.lit(False))
    rule = F.when(known, made(had["cwe"], had["cwe_title"], had["severity"], had["cwe"])).otherwise(rule)
    advice = F.when(F.col("class_cwe") != "CWE-0", remediation(F.col("class_cwe")))
    return hooks.withColumn("_c", rule).select(*hooks.columns, "_c.*").withColumn("remediation", advice)


def cwe_stats(classified: DataFrame, order: Column) -> DataFrame:
    """classified (class_cwe, class_title, path, line_start, func): class, count, the first title, and one of the places of each row of the class.

    The places of one class may be many, so they stay rows: n and the title stand beside each.
    """
    tally = classified.groupBy("class_cwe").agg(F.count("*").alias("n"), F.min_by("class_title", order).alias("first_title"))
    return classified.select("class_cwe", "path", "line_start", "func").join(tally, "class_cwe")


def confidence(fp_filtered: Column, severity: Column, snippet: Column) -> Column:
    points = F.when(~fp_filtered, 20).otherwise(0) + F.when(severity == "critical", 15).when(severity == "high", 10).otherwise(0) + F.when(snippet.rlike("(?iu)" + R.NAMED_VALUE), 10).otherwise(0)
    return F.least(F.lit(95), points + 30)


_FOUND = "array<struct<rule:int,hook_type:string,severity:string,cwe:string,cwe_title:string,description:string,pattern:string>>"


def scan_lines(files: DataFrame) -> DataFrame:
    """files (path, language, content, any others): a row for each line and rule that matches it, with an id of path, line and pattern.

    A language's patterns are tried together on the text and on each line before they are tried one by one. Patterns
    are literals, each compiled once. Lines end at \\n, \\r or both; a null text has none.
    """
    every = {language: [pattern for *_, pattern in rows] for language, rows in R.GREP_RULES.items()}
    keep = [c for c in files.columns if c != "content"]
    lines = files.where(_by_language(every, F.col("content"))).select(*keep, F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "line"))
    found = F.lit(None).cast(_FOUND)
    for language, rows in R.GREP_RULES.items():
        hits = [
            F.when(F.col("line").rlike("(?iu)" + pattern), F.struct(F.lit(n).alias("rule"), *[F.lit(v).alias(c) for c, v in zip(("hook_type", "severity", "cwe", "cwe_title", "description", "pattern"), (*told, pattern))]))
            for n, (*told, pattern) in enumerate(rows)
        ]
        found = F.when(F.col("language") == language, F.filter(F.array(*hits), lambda h: h.isNotNull())).otherwise(found)
    rows = lines.where(_by_language(every, F.col("line"))).withColumn("hit", F.explode(found))
    line = F.col("at") + 1
    key = F.substring(F.sha2(F.concat_ws(":", F.col("path"), line.cast("string"), F.col("hit.pattern")), 256), 1, 16)
    snippet = F.substring(F.regexp_replace("line", r"(?U)\s+$", ""), 1, 300)
    return rows.select(*keep, key.alias("hook_id"), line.alias("line_start"), *[F.col(f"hit.{c}") for c in ("rule", "hook_type", "severity", "cwe", "cwe_title", "description")], snippet.alias("snippet"))


def severity_summary(rows: DataFrame, column: str) -> DataFrame:
    """Rows for every severity, 0 where there is none."""
    every = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(R.SEVERITIES)], "severity string, ord int")
    counts = rows.groupBy(F.col(column).alias("severity")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(counts.where(F.col("severity").isin(R.SEVERITIES))), "severity", "left").select("severity", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def extraction_summary(files: DataFrame, hooks: DataFrame, errors: DataFrame) -> DataFrame:
    """files (path), hooks (path, hook_type, severity), errors (path): kind, name, n. Files count if they have hooks or errors.

    Every severity has a row, 0 where there is none; types have one where they occur.
    """
    with_hooks, with_errors = hooks.select("path").distinct(), errors.select("path").distinct()
    touched = with_hooks.unionByName(with_errors).distinct().join(files.select("path").distinct(), "path", "left_semi")
    total = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    out = total(touched, "files_scanned").unionByName(total(with_hooks, "files_with_hooks")).unionByName(total(hooks, "total_hooks")).unionByName(total(errors, "total_errors"))
    out = out.unionByName(severity_summary(hooks, "severity").select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), "n"))
    return out.unionByName(hooks.groupBy(F.col("hook_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n"))


def to_findings(hooks: DataFrame) -> DataFrame:
    """Classified and scored hooks as findings: title, severity, cwe, confidence, description, poc, verdict, cwe_title, remediation, path, func, line_start."""
    name = lambda c, other: F.coalesce(c, F.lit(other))
    title = F.concat(name(F.col("class_cwe"), "CWE-0"), F.lit(": "), F.coalesce("class_title", "class_type", F.lit("?")), F.lit(" in "), name(F.col("func"), "?"), F.lit("()"))
    severity = F.when(F.coalesce("class_severity", F.lit("")) == "", "info").otherwise(F.col("class_severity"))
    return hooks.select(
        title.alias("title"), severity.alias("severity"), name(F.col("class_cwe"), "N/A").alias("cwe"), "confidence", name(column_or_null(hooks, "description"), "").alias("description"),
        name(F.col("snippet"), "").alias("poc"), F.lit("unreviewed").alias("verdict"), name(F.col("class_title"), "").alias("cwe_title"), name(F.col("remediation"), "").alias("remediation"),
        F.col("path").alias("file_path"), F.col("func").alias("func_name"), F.col("line_start"),
    )


#: Hooks of each kind that a summary names.
CAPS = {"route_entry": 20, "input_source": 20, "other": 30}


def buckets(hooks: DataFrame, order: list[str]) -> DataFrame:
    """hooks (path, line_start, func, called, severity, hook_type): bucket, place in it, line; the first CAPS of each bucket in the given order.

    Each bucket's first rows are found by pre-aggregated top lists, so a bucket of any size is no hot task.
    """
    kind = F.when(F.col("hook_type").isin("route_entry", "input_source"), F.col("hook_type")).otherwise("other")
    line = F.format_string("  - %s:%d %s() calls %s() [%s]", "path", F.col("line_start").cast("long"), F.coalesce("func", F.lit("None")), F.coalesce(F.nullif("called", F.lit("")), F.lit("?")), "severity")
    rows = hooks.select(kind.alias("bucket"), F.struct(*order, line.alias("line")).alias("row"))
    slot = F.pmod(F.xxhash64("row"), F.lit(256))
    most = max(CAPS.values())
    top = F.slice(F.array_sort(F.collect_list("row")), 1, most)
    first = rows.withColumn("slot", slot).withColumn("n", F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("row"))).where(F.col("n") <= most)
    merged = first.groupBy("bucket").agg(top.alias("rows")).select("bucket", F.posexplode("rows").alias("place", "row"))
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    return merged.where(F.col("place") < F.element_at(cap, F.col("bucket"))).select("bucket", (F.col("place") + 1).alias("place"), "row.line")


def project_type(files: DataFrame) -> DataFrame:
    """files (path): the kind of project, by the endings that occur."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    has = lambda *names: F.coalesce(F.bool_or(ending.isin(*names)), F.lit(False))
    kind = F.when(has(".py"), "Python Web Application (Flask/FastAPI/Django)").when(has(".go"), "Go Application").when(has(".js", ".ts"), "JavaScript/TypeScript Application (Node.js/Express)").when(has(".java"), "Java Application (Spring Boot)")
    return files.agg(kind.otherwise("Unknown").alias("project_type"))


def comply(findings: DataFrame) -> DataFrame:
    """findings (cwe, severity, confidence) with low_impact, platform_severity and submittable."""
    low = F.coalesce(F.col("cwe").isin(R.LOW_IMPACT), F.lit(False))
    step = F.create_map(*[F.lit(x) for pair in zip(R.SEVERITIES, R.SEVERITIES[1:] + ["info"]) for x in pair])
    severity = F.when(low, F.coalesce(F.try_element_at(step, F.col("severity")), F.col("severity"))).otherwise(F.col("severity"))
    fit = ~low & F.coalesce(severity.isin("critical", "high", "medium") & (F.col("confidence") >= 60), F.lit(False))
    return findings.withColumns({"low_impact": low, "platform_severity": severity, "submittable": fit})


def chosen(hooks: DataFrame, status: str | None = None, severity: str | None = None, hook_type: str | None = None) -> DataFrame:
    """hooks that meet every condition given; None asks for none."""
    for column, value in (("status", status), ("severity", severity), ("hook_type", hook_type)):
        hooks = hooks.where(F.col(column) == value) if value is not None else hooks
    return hooks


def pending(hooks: DataFrame, n: int | None = None) -> DataFrame:
    """Hooks still to be analysed; of n, the first by hook_id."""
    rows = hooks.where(F.col("status") == "pending")
    return rows if n is None else rows.orderBy("hook_id").limit(n)
