"""Statements of free-text findings, held against what a project has and against each other; the points that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .calls import chunks
from .hooks import language_of

CHECKS = 5


def all_groups(text: Column, patterns: list[str], flags: str = "") -> Column:
    """The first group of every match of every pattern, in the patterns' order."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(flags + p), 1) for p in patterns)))


# what a project has
def file_names(files: DataFrame) -> DataFrame:
    """files (path): name: each file's name and its path."""
    return files.select(F.explode(F.array(F.substring_index("path", "/", -1), F.col("path"))).alias("name")).distinct()


def declared_names(files: DataFrame) -> DataFrame:
    """files (path, content): name: functions, methods and classes."""
    return chunks(files).where("name <> '<unknown>'").select("name").distinct()


def variables(content: Column) -> Column:
    """Distinct names of more than one letter that a text assigns or takes as parameters, by patterns."""
    words = F.flatten(F.transform(all_groups(content, R.VARIABLES), lambda g: F.regexp_extract_all(g, F.lit(r"(\w+)"), 1)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def imports(content: Column, language: Column) -> Column:
    """Distinct modules that a text imports, by its language's patterns."""
    out = F.array().cast("array<string>")
    for name, patterns in R.IMPORTS.items():
        out = F.when(language == name, F.array_distinct(all_groups(content, patterns))).otherwise(out)
    return out


def project_index(files: DataFrame) -> DataFrame:
    """files (path, content): path, variables and imports of each, what claims about one file are held against."""
    language = F.col("language") if "language" in files.columns else language_of(F.col("path"))
    return files.where("content is not null").select("path", variables(F.col("content")).alias("variables"), imports(F.col("content"), language).alias("imports"))


# what a text claims
def claim_text(findings: DataFrame) -> Column:
    """Title, description or else reason, and poc_code or else poc, as lines."""
    have = lambda *names: F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names if n in findings.columns], F.lit(""))
    return F.concat_ws("\n", have("title"), have("description", "reason"), have("poc_code", "poc"))


def file_claims(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (id, text) against files (name): a row for each file named in a text that the project lacks.

    Repeats count, as one file may be named in several ways. Names are joined, never collected.
    """
    rows = findings.select("id", F.explode(F.transform(all_groups(F.col("text"), R.FILE_CLAIMS), lambda n: F.trim(n))).alias("name"))
    rows = rows.where(~F.col("name").rlike(R.NOT_FILES) & F.col("name").rlike(r"\.[a-z]{2,6}$"))
    return rows.join(files.select("name").distinct(), "name", "left_anti").select("id", "name")


def function_claims(findings: DataFrame, names: DataFrame) -> DataFrame:
    """findings (id, text) against names (name): functions called at least twice in a text that the project lacks, with their count."""
    rows = findings.select("id", F.explode(F.regexp_extract_all("text", F.lit(R.FUNCTION_CLAIM), 1)).alias("name"))
    counts = rows.where(~F.col("name").isin(R.BUILT_IN + R.COMMON_WORDS)).groupBy("id", "name").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.join(names.select("name").distinct(), "name", "left_anti").select("id", "name", "n")


def parameter_claims(findings: DataFrame, index: DataFrame) -> DataFrame:
    """findings (id, text, path) against the index: parameters of more than two letters that the named file lacks. Files out of the index are not judged."""
    named = F.regexp_extract_all("text", F.lit("(?i)" + R.PARAMETER_CLAIM), 1)
    rows = findings.select("id", "path", F.explode(named).alias("name")).where(F.length("name") > 2)
    return rows.join(index.select("path", "variables"), "path").where(~F.array_contains("variables", F.col("name"))).select("id", "path", "name")


def library_claims(findings: DataFrame, index: DataFrame) -> DataFrame:
    """findings (id, text, path) against the index: libraries, not known ones, of which no import of the file begins with the first part."""
    named = F.regexp_extract_all("text", F.lit("(?i)" + R.LIBRARY_CLAIM), 1)
    rows = findings.select("id", "path", F.explode(named).alias("name")).where(~F.lower("name").isin(R.KNOWN_LIBRARIES))
    root = F.substring_index("name", ".", 1)
    return rows.join(index.select("path", "imports"), "path").where(~F.exists("imports", lambda i: F.startswith(i, root))).select("id", "path", "name")


def contradiction(text: Column) -> Column:
    """'always' and 'never' in one paragraph."""
    return F.coalesce(F.exists(F.split(F.lower(text), "\n\n"), lambda p: F.contains(p, F.lit("always")) & F.contains(p, F.lit("never"))), F.lit(False))


def contradicting(text: Column) -> Column:
    """The first paragraph with 'always' and 'never'; null if none has both."""
    both = lambda p: F.contains(F.lower(p), F.lit("always")) & F.contains(F.lower(p), F.lit("never"))
    return F.try_element_at(F.filter(F.split(text, "\n\n"), both), F.lit(1))


def silent_proof(text: Column) -> Column:
    """A text speaks of a return, and the fenced code of its proof neither returns nor prints."""
    proof = F.regexp_extract(text, f"({R.POC_CLAIM})", 1)
    return F.coalesce(F.lower(text).contains("return") & (proof != "") & ~proof.contains("return") & ~proof.contains("print"), F.lit(False))


def _severity_claim(text: Column) -> tuple[Column, Column, Column]:
    """What severity a text claims, of which class, and what that class is expected to have."""
    expected = F.create_map(*[F.lit(x) for pair in R.CWE_SEVERITY.items() for x in pair])
    cwe = F.regexp_extract(text, r"(CWE-\d+)", 1)
    return F.regexp_extract(text, R.SEVERITY_CLAIM, 1), cwe, F.try_element_at(expected, cwe)


def wrong_severity(text: Column) -> Column:
    """A severity that is not the one expected of the first class named; false if either is missing."""
    said, _, want = _severity_claim(text)
    return F.coalesce((said != "") & (said != want), F.lit(False))


def issues(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (id, path, title, description, poc_code ...) against files (path, content): id, kind, severity, detail, n (how often).

    Five checks: files, functions, parameters, libraries and the text's own logic. Joins only; no name is collected.
    """
    texts = findings.select("id", "path", claim_text(findings).alias("text"))
    index = project_index(files)
    made = lambda rows, check, kind, severity, detail, n=F.lit(1): rows.select("id", F.lit(check).alias("check"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), detail.alias("detail"), n.cast("long").alias("n"))
    out = made(file_claims(texts, file_names(files)), 1, "naming", "warning", F.concat(F.lit("Referenced file '"), "name", F.lit("' not found in project")))
    functions = function_claims(texts, declared_names(files))
    out = out.unionByName(made(functions, 2, "naming", "warning", F.concat(F.lit("Function '"), "name", F.lit("()' referenced but not found in codebase")), F.col("n")))
    out = out.unionByName(made(parameter_claims(texts, index), 3, "mapping", "error", F.concat(F.lit("Parameter '"), "name", F.lit("' is not found in "), "path")))
    out = out.unionByName(made(library_claims(texts, index), 4, "resource", "warning", F.concat(F.lit("Library '"), "name", F.lit("' is not imported in "), "path")))
    said, cwe, want = _severity_claim(F.col("text"))
    logic = F.filter(
        F.array(
            F.concat(F.lit("Paragraph contains both 'always' and 'never': '"), F.substring(contradicting(F.col("text")), 1, 120), F.lit("...'")),
            F.when(silent_proof(F.col("text")), "Return behavior is described but the proof shows no return/print"),
            F.when(wrong_severity(F.col("text")), F.concat(F.lit("Severity '"), said, F.lit("' inconsistent with "), cwe, F.lit(" (expected '"), want, F.lit("')"))),
        ),
        lambda x: x.isNotNull(),
    )
    return out.unionByName(made(texts.select("id", F.explode(logic).alias("told")), 5, "logic", "error", F.col("told")))


def verdicts(findings: DataFrame, found: DataFrame) -> DataFrame:
    """findings (id) with found issues: checks_run, checks_passed, passed, penalty, boost. A finding without issues passes all."""
    many = lambda severity: F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("n"))), F.lit(0))
    tally = found.groupBy("id").agg(F.countDistinct("check").alias("failed"), many("error").alias("errors"), many("warning").alias("warnings"))
    rows = findings.select("id").join(tally, "id", "left")
    none = F.lit(0)
    rows = rows.select("id", (CHECKS - F.coalesce("failed", none)).cast("int").alias("checks_passed"), F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))
    return rows.select(
        "id", F.lit(CHECKS).alias("checks_run"), "checks_passed", (F.col("errors") == 0).alias("passed"), (F.col("errors") * 5.0 + F.col("warnings") * 2.0).alias("penalty"),
        F.bround(F.col("checks_passed") / CHECKS * 15.0, 1).alias("boost"),
    )


def ladder(checked: Column, confirmed: Column, second_model: Column, reproduced: Column) -> Column:
    """Points of the stages passed; null passes none."""
    steps = zip((checked, confirmed, second_model, reproduced), R.LADDER)
    return sum((F.when(passed, points).otherwise(0) for passed, points in steps), F.lit(0))
