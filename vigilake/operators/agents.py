"""Answers of models as data: lenient JSON, what becomes of a hook, what is asked next, and trials. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .hooks import language_of
from .order import running_sum
from .tables import settle

MARKER = "FINAL_RESULT"
SNIPPET = 3000


def lenient_json(raw: Column) -> Column:
    """The JSON text in an answer, or null: a ```json fence, else a plain fence, else all of it; if that does not parse, from the first { to the last }, then [ to ]."""
    clean = F.trim(F.replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(MARKER), F.lit("")))
    after_json = F.split_part(F.regexp_replace(clean, r"(?s)^.*?```json", ""), F.lit("```"), F.lit(1))
    fenced = F.when(clean.contains("```json"), after_json).when(clean.contains("```"), F.split_part(clean, F.lit("```"), F.lit(2))).otherwise(clean)
    between = lambda a, b: F.nullif(F.regexp_extract(clean, rf"(?s)(\{a}.*\{b})", 1), F.lit(""))
    inside = lambda a, c, b: F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull()
    # the parser overlooks what follows a value: as a member of an object and of an array it must be all there is
    parsed = lambda c: F.when(inside("[", c, "]") & inside('{"x":', c, "}"), F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(parsed(fenced), parsed(between("{", "}")), parsed(between("[", "]")))


def metadata(column: Column) -> Column:
    """A JSON object as it is; an empty one where the text is none."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False)), column).otherwise("{}")


_FINDING = "struct<title:string,cwe:string,severity:string,confidence:double,is_vulnerable:boolean,reason:string,poc:string>"


def outcomes(answers: DataFrame) -> DataFrame:
    """answers (hook_id, raw): hook_id, status, confidence, and the finding's columns where there is one.

    No finding: verified with 0. Found not vulnerable: false_positive. Else verified, a true positive, severity medium and
    confidence 0.5 where the answer names none. An answer that holds no JSON leaves the hook in analysis.
    """
    text = answers.select("hook_id", lenient_json(F.col("raw")).alias("json"))
    rows = text.withColumn("f", F.from_json("json", f"finding {_FINDING}, reason string"))
    f, safe = F.col("f.finding"), F.coalesce(F.col("f.finding.is_vulnerable") == F.lit(False), F.lit(False))
    real = f.isNotNull() & ~safe
    status = F.when(F.col("json").isNull(), "analyzing").when(f.isNull(), "verified").when(safe, "false_positive").otherwise("verified")
    confidence = F.when(F.col("json").isNull(), None).when(f.isNull(), 0.0).when(safe, F.coalesce(f["confidence"], F.lit(0.0))).otherwise(F.coalesce(f["confidence"], F.lit(0.5)))
    had = lambda name, other: F.when(real, F.coalesce(f[name], F.lit(other)))
    return rows.select(
        "hook_id", status.alias("status"), confidence.alias("confidence"), F.when(real, "true_positive").alias("verdict"), had("severity", "medium").alias("severity"), had("title", "Untitled").alias("title"),
        had("reason", "").alias("description"), had("poc", "").alias("poc_code"), had("cwe", "").alias("cwe_id"),
    )


def finding_id(hook_id: Column, title: Column, description: Column) -> Column:
    """An id of what a finding says about its hook."""
    return F.concat(F.lit("FIND-"), F.substring(F.sha2(F.to_json(F.struct(hook_id.alias("hook_id"), title.alias("title"), description.alias("description"))), 256), 1, 12))


def audit_findings(answers: DataFrame) -> DataFrame:
    """Findings of answers, with ids and the agent."""
    rows = outcomes(answers).where(F.col("verdict").isNotNull())
    return rows.select(finding_id(F.col("hook_id"), F.col("title"), F.col("description")).alias("finding_id"), "hook_id", F.lit("Auditor").alias("agent_id"), "severity", "title", "description", "poc_code", "cwe_id", "verdict", "confidence")


def advance(hooks: DataFrame, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """hooks (hook_id, status, confidence, ...) after a round: asked (hook_id) are in analysis, answers (hook_id, raw; one each) settle theirs.

    Only hooks still pending or in analysis change.
    """
    state = asked.select("hook_id").distinct().withColumn("_asked", F.lit(True)).join(outcomes(answers).select("hook_id", F.col("status").alias("_status"), F.col("confidence").alias("_confidence")), "hook_id", "full")
    rows = hooks.join(state, "hook_id", "left")
    free = F.col("status").isin("pending", "analyzing")
    status = F.when(free, F.coalesce("_status", F.when(F.col("_asked"), "analyzing"), "status")).otherwise(F.col("status"))
    confidence = F.when(free, F.coalesce("_confidence", "confidence")).otherwise(F.col("confidence"))
    return rows.withColumns({"status": status, "confidence": confidence}).select(hooks.columns)


def audit_rounds(hooks: DataFrame, answers: DataFrame, budget: int, rounds: int = 3, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Rounds of asking until nothing is left to ask, the budget is spent or `rounds` are over: hooks at the end, and a row for each round.

    hooks (hook_id, seq, status, confidence, ...), answers (round, hook_id, raw, cost). In a round every hook still pending or in analysis is
    asked, in the order of seq, as long as what was spent before it stays below share * budget: earlier rounds, and the costs of the
    round's earlier calls. An answered hook is settled by its answer; one without an answer, or whose answer holds nothing, stays. A null cost is 0. The rows of
    rounds: round, asked, refused, spent (after the round). A round's result is a written table; only its three sums reach the driver.
    """
    spark, gate, spent, log = hooks.sparkSession, int(budget * share), 0, []
    now = hooks
    for r in range(1, rounds + 1):
        mine = answers.where(F.col("round") == r).select("hook_id", "raw", F.coalesce("cost", F.lit(0)).cast("long").alias("_cost"))
        open_ = now.where(F.col("status").isin("pending", "analyzing")).select("hook_id", "seq").join(mine, "hook_id", "left")
        calls = settle(running_sum(open_, "seq", F.coalesce("_cost", F.lit(0)), "_before", ties=["hook_id"]).withColumn("_asked", F.col("_before") + spent < gate), "calls")
        tally = calls.agg(F.count_if("_asked").alias("asked"), F.count_if(~F.col("_asked")).alias("refused"), F.coalesce(F.sum(F.when(F.col("_asked"), F.col("_cost"))), F.lit(0)).alias("cost")).first()
        if not tally.asked and not tally.refused:
            break
        spent += tally.cost
        log.append((r, tally.asked, tally.refused, spent))
        asked = calls.where("_asked")
        now = settle(advance(now, asked.select("hook_id"), asked.where("raw is not null").select("hook_id", "raw")), "round")
        if not tally.asked:
            break
    return now, spark.createDataFrame(log, "round int, asked long, refused long, spent long")


def hook_id(path: Column, func: Column, line: Column) -> Column:
    """The id of a hook that names none: of its path, function and first line; nulls read None."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws(":", told(path), told(func), told(line)), 256), 1, 16)


def proposed_hooks(raw: DataFrame) -> DataFrame:
    """raw (id, raw): hooks that an architect's answer proposes, pending, with severity high; answers that hold no JSON give none."""
    kind = "hooks array<struct<file_path:string,function_name:string,hook_type:string,risk_reason:string,line_start:int,line_end:int>>"
    rows = raw.select("id", F.explode(F.from_json(lenient_json(F.col("raw")), kind)["hooks"]).alias("h"))
    path, func = F.coalesce("h.file_path", F.lit("")), F.coalesce("h.function_name", F.lit("unknown"))
    first, last = F.coalesce("h.line_start", F.lit(0)), F.coalesce("h.line_end", F.lit(0))
    return rows.select(
        "id", hook_id(path, func, first).alias("hook_id"), path.alias("file_path"), func.alias("func_name"), F.coalesce("h.hook_type", F.lit("unknown")).alias("hook_type"), F.coalesce(language_of(path), F.lit("unknown")).alias("language"),
        F.lit("high").alias("severity"), first.alias("line_start"), last.alias("line_end"), F.coalesce("h.risk_reason", F.lit("")).alias("snippet"), F.lit("pending").alias("status"),
    )


def audit_context(hooks: DataFrame, of_chunk: DataFrame, near: DataFrame, files: DataFrame) -> DataFrame:
    """What is asked about a hook: hook_id, line_start, line_end, risk_reason, snippet, context.

    hooks (hook_id, path, line_start, line_end, metadata, risk_reason, snippet); of_chunk as chunk_of_hook() gives it; near as nearby()
    does; files (path, content). The code is the chunk, else the start of the file, else what the hook says itself.
    """
    around = near.groupBy("hook_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda n: n["text"]), "\n\n").alias("around"))  # three at most
    chunk = of_chunk.select("hook_id", F.col("line_start").alias("_from"), F.col("line_end").alias("_to"), F.col("snippet").alias("_chunk"))
    rows = hooks.join(chunk, "hook_id", "left").join(around, "hook_id", "left").join(files.select("path", F.substring("content", 1, SNIPPET).alias("_file")), "path", "left")
    code = F.substring(F.coalesce("_chunk", "_file", F.nullif("snippet", F.lit("")), "risk_reason"), 1, SNIPPET)
    told = F.coalesce(F.get_json_object(metadata(F.coalesce("metadata", F.lit("{}"))), "$.description"), F.col("risk_reason"), F.lit("Suspicious call detected"))
    return rows.select(
        "hook_id", F.coalesce("_from", "line_start").alias("line_start"), F.coalesce("_to", "line_end").alias("line_end"), told.alias("risk_reason"),
        F.coalesce(F.nullif(code, F.lit("")), F.lit("(unable to extract code)")).alias("snippet"), F.coalesce("around", F.lit("(no additional context available)")).alias("context"),
    )


def findings_of_hooks(hooks: DataFrame, findings: DataFrame) -> DataFrame:
    """hooks (hook_id) with their findings (finding_id, hook_id, title, severity, cwe_id, poc_code) as text, a row each."""
    name = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    text = F.concat(F.lit("Finding: "), name("title", "?"), F.lit("\nSeverity: "), name("severity", "?"), F.lit(" | CWE: "), name("cwe_id", "N/A"), F.lit("\nPoC:\n"), name("poc_code", "(none)"))
    return hooks.select("hook_id").distinct().join(findings, "hook_id").select("hook_id", "finding_id", text.alias("text"))


def with_hook(findings: DataFrame, hooks: DataFrame, order: str) -> DataFrame:
    """findings (hook_id, ...) with path and func of their hook, the first of an id by `order`; null where there is none."""
    first = hooks.groupBy("hook_id").agg(F.min_by(F.struct("path", "func"), order).alias("_h"))
    return findings.join(first, "hook_id", "left").select(*[F.col(c) for c in findings.columns], F.col("_h.path").alias("path"), F.col("_h.func").alias("func"))


_JURY = "verdict string, final_score double, reasoning string, severity string"


def trials(transcript: DataFrame) -> DataFrame:
    """transcript (finding_id, round, role, raw): one row for each finding: trial_id, rounds held, last views of both sides, the judge's summary, the jury's verdict.

    Roles are prosecutor, defender, judge and jury; the judge and the jury speak after the rounds. Without a readable
    verdict it is 'unknown' with 0 points. A valid verdict is worth 25 points.
    """
    said = transcript.select("finding_id", "round", "role", F.coalesce(lenient_json(F.col("raw")), F.lit("{}")).alias("view"))
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("view")), F.when(F.col("role") == role, F.col("round")))
    side = F.col("role").isin("prosecutor", "defender")
    rows = said.groupBy("finding_id").agg(
        F.coalesce(F.max(F.when(side, F.col("round"))), F.lit(0)).alias("rounds"), F.coalesce(of("prosecutor"), F.lit("{}")).alias("prosecutor_view"), F.coalesce(of("defender"), F.lit("{}")).alias("defender_view"),
        F.coalesce(of("judge"), F.lit("{}")).alias("judge_summary"), F.from_json(of("jury"), _JURY).alias("jury"),
    )
    verdict = F.coalesce("jury.verdict", F.lit("unknown"))
    return rows.select(
        F.concat(F.lit("TRIAL-"), F.col("finding_id").cast("string"), F.lit("-R"), F.col("rounds").cast("string")).alias("trial_id"), "finding_id", "rounds", "prosecutor_view", "defender_view", "judge_summary",
        verdict.alias("jury_verdict"), F.coalesce("jury.final_score", F.lit(0.0)).alias("jury_score"), F.coalesce("jury.reasoning", F.lit("")).alias("jury_reasoning"), F.when(verdict == "valid", R.LADDER[1]).otherwise(0).alias("points"),
    )


def class_reference() -> str:
    """What a prompt says of the classes: name, what it looks like in code, and advice."""
    told = (f"- {cwe}: {name}\n  Look for: {'; '.join(signals)}\n  What helps: {fix}" for cwe, (name, signals, fix) in R.CLASSES.items())
    return "\n".join([f"## {len(R.CLASSES)} classes of weaknesses", "", *told])


def charge(finding: dict[str, Column], code: Column) -> Column:
    """The text that a trial begins with. finding: id, title, severity, cwe, confidence, description, path, func, language."""
    told = lambda name, other: F.coalesce(finding[name].cast("string"), F.lit(other))
    return F.concat(
        F.lit("## Case: "), told("id", "UNKNOWN"), F.lit("\n## Charge: "), told("title", "Untitled"), F.lit("\n## Audit\n- Severity: "), told("severity", "unknown"), F.lit("\n- CWE: "), told("cwe", "N/A"),
        F.lit("\n- Confidence: "), told("confidence", "0.0"), F.lit("\n- Description: "), told("description", "N/A"), F.lit("\n\n## Place\n- File: "), told("path", "?"), F.lit("\n- Function: "), told("func", "?"),
        F.lit("\n- Language: "), told("language", "unknown"), F.lit("\n\n## Code\n```\n"), F.substring(F.coalesce(code, F.lit("")), 1, SNIPPET), F.lit("\n```"),
    )
