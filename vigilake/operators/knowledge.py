"""Patterns of known vulnerabilities: made of confirmed findings, and retrieved for snippets by rules and by vectors.

Neither side is collected. A rule meets the snippets that hold a letter triple of each literal that it requires (factors.py), by
a join on the triple's number; only what then matches is scored. What needs no rule, the class and the words, depends on few
values: patterns of one class and the same words compete by age alone, so the best of each such kind stand for all. Vectors go
through a partitioned index (vectors.py). Of every kind of candidates at most k reach the merge for a snippet.

Rows may repeat, ids and pids be null or shared: equal snippets are searched once and each gets its own answer; equal patterns are
found as often as they stand in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from . import factors, vectors
from .tables import settle

FREE = 500  # rules without a literal that meet the snippets at once
BEST = 3
LEAST_TEXT = 10


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def pattern_type(cwe: Column) -> Column:
    """The name of a class, else its number alone."""
    return F.coalesce(_mapped(R.PATTERN_TYPES, cwe), F.lower(F.replace(cwe, F.lit("CWE-"), F.lit(""))))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def code_signature(snippet: Column) -> Column:
    """A regular expression of a snippet's first 200 characters, in which common names stand for any word."""
    out = F.regexp_replace(F.substring(stripped(snippet), 1, 200), r"([()\[\]{}?*+\-|^$\\.&~#\s])", r"\\$1")
    for name in R.SIGNATURE_NAMES:
        out = F.replace(out, F.lit(name), F.lit(r"\w+"))
    return out


def detection_rule(cwe: Column, language: Column) -> Column:
    """The rule of a class for a language, else its general one, else an empty text."""
    table = {f"{c}/{g}": rule for c, rules in R.DETECTION.items() for g, rule in rules.items()}
    return F.coalesce(_mapped(table, F.concat_ws("/", cwe, language)), _mapped(table, F.concat(cwe, F.lit("/default"))), F.lit(""))


def first_hooks(hooks: DataFrame, order: str) -> DataFrame:
    """The first hook of each id."""
    return hooks.groupBy("hook_id").agg(F.min_by(F.struct(*[c for c in hooks.columns if c != "hook_id"]), order).alias("_h")).select("hook_id", "_h.*")


def extract_patterns(findings: DataFrame, hooks: DataFrame) -> DataFrame:
    """findings (finding_id, hook_id, cwe_id, description) and hooks (hook_id, snippet, language): a pattern of each finding that has a class.

    hooks has one row for each id. Without a hook, or a snippet in it, the description stands for the code.
    """
    rows = findings.where(F.col("cwe_id").startswith("CWE-")).join(hooks.select("hook_id", "snippet", "language"), "hook_id", "left")
    text = F.coalesce("description", F.lit(""))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.col("snippet")).otherwise(F.substring(text, 1, 500))
    cwe, language = F.col("cwe_id"), F.coalesce("language", F.lit("unknown"))
    return rows.select(
        "finding_id", pattern_type(cwe).alias("pattern_type"), "cwe_id", code_signature(snippet).alias("code_signature"), F.substring(snippet, 1, 1000).alias("vulnerable_snippet"),
        F.substring(text, 1, 800).alias("fix_snippet"), detection_rule(cwe, language).alias("detection_rule"), F.lit("audit_pipeline").alias("source_project"),
    )


def bulk_patterns(findings: DataFrame) -> DataFrame:
    """findings (finding_id, verdict, cwe_id, description): patterns of the true positives that have a class, without rules."""
    rows = findings.where((F.col("verdict") == "true_positive") & (F.coalesce("cwe_id", F.lit("")) != ""))
    return rows.select(
        "finding_id", F.coalesce(_mapped(R.BULK_PATTERN_TYPES, F.col("cwe_id")), F.lit("unknown")).alias("pattern_type"), "cwe_id", F.lit("").alias("code_signature"),
        F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("vulnerable_snippet"), F.lit("").alias("fix_snippet"), F.lit("").alias("detection_rule"), F.lit("auto-extract").alias("source_project"),
    )


_FOUND = "array<struct<negative:double,place:long,pid:long>>"
_WORDS = [w.lower() for w in R.RETRIEVAL_WORDS]


def _words(text: Column) -> Column:
    """Which of the retrieval words a text holds, as bits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bits = F.lit(0)
    for i, w in enumerate(_WORDS):
        bits = bits + F.when(F.contains(low, F.lit(w)), F.lit(1 << i)).otherwise(0)
    return bits.cast("int")


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _keyed(snippets: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of snippets by some columns, with their number `copies` and a key."""
    rows = snippets.groupBy("id", *columns).agg(F.count("*").alias("copies"))
    return rows.withColumn("key", _digest("id", *columns))


def _answers(keyed: DataFrame, found: DataFrame, column: str = "found") -> DataFrame:
    """id and what was found for its key, an empty list if nothing, for each copy."""
    rows = keyed.select("id", "key", "copies").join(found, "key", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("id", F.coalesce(column, F.array().cast(found.schema[column].dataType)).alias(column))


def _first(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The first k patterns of each group; cut within each partition before rows are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "place", F.col("pid").asc_nulls_last(), "rid")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)


def _lists(found: DataFrame, k: int) -> DataFrame:
    """key, negative, place, pid, n, _at of at most k patterns a key: one list each, equal patterns as often as they stand."""
    one = F.struct("_at", F.struct(F.col("negative").cast("double"), F.col("place").cast("long"), F.col("pid").cast("long")).alias("p"), F.least("n", F.lit(k)).cast("int").alias("n"))
    each = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.array_repeat(x["p"], x["n"]))
    return found.groupBy("key").agg(F.slice(F.flatten(each), 1, k).cast(_FOUND).alias("found"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, place of each triple by which a pattern's rules are looked up; place -1 where one must be tried on every snippet."""
    for batch in batches:
        rids, places = [], []
        for rid, *of_pattern in zip(*(batch.column(c).to_pylist() for c in ("rid", "rule", "signature"))):
            asked = [factors.key_places(r) for r in of_pattern if factors.compiled(r)]
            every = [-1] if None in asked else sorted({p for ps in asked for p in ps})
            rids += [rid] * len(every)
            places += every
        yield pa.record_batch([pa.array(rids, pa.string()), pa.array(places, pa.int32())], ["rid", "at"])


def _looked_up(known):
    """key, place of each triple of a snippet that some rule is looked up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("folded").to_pylist()):
                places = factors.places_in(text, known.value)
                if places:
                    yield pa.record_batch([pa.array([key] * len(places), pa.string()), pa.array(places, pa.int32())], ["key", "at"])

    return run


def hits(rule: str | None, signature: str | None, text: str, low: str) -> int:
    """5 if the rule is found in a text, 4 more if the signature is; low: the folded text."""
    points = 0
    for worth, r in ((5, rule), (4, signature)):
        needed = factors.required(r) if r else None
        if factors.compiled(r) and (needed is None or any(x in low for x in needed)) and factors.compiled(r).search(text):
            points += worth
    return points


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a snippet and a pattern whose rule or signature is found, with the points for it."""
    for batch in batches:
        points = [hits(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("rule", "signature", "snippet", "folded")))]
        met = [i for i, p in enumerate(points) if p]
        keep = [c for c in batch.schema.names if c not in ("rule", "signature", "snippet", "folded")]
        yield pa.record_batch([*(batch.column(c).take(pa.array(met, pa.int64())) for c in keep), pa.array([points[i] for i in met], pa.int32())], [*keep, "points"])


def _matched(rows: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """rows (key, snippet, suspected): key, found."""
    spark = rows.sparkSession
    fields = ["pid", "cwe_id", "code_signature", "vulnerable_snippet", "detection_rule", "seen"]
    whole = settle(patterns.groupBy(*fields).agg(F.count("*").alias("n")).select(
        _digest(*fields).alias("rid"), F.col("pid").cast("long").alias("pid"), (-F.coalesce("seen", F.lit(0))).cast("long").alias("place"), "n", F.col("cwe_id").alias("cwe"), _words(F.col("vulnerable_snippet")).alias("words"),
        F.col("detection_rule").alias("rule"), F.col("code_signature").alias("signature"),
    ), "patterns")
    asked = rows.select("key", F.coalesce("snippet", F.lit("")).alias("snippet"), "suspected").withColumn("mine", _words(F.col("snippet"))).withColumn("folded", factors.folded(F.col("snippet")))
    score = lambda points: 3 * F.coalesce(F.col("cwe") == F.col("suspected"), F.lit(False)).cast("int") + points + F.least(F.lit(3), F.bit_count(F.col("words").bitwiseAND(F.col("mine"))))

    # by class and words alone: kinds of patterns against kinds of snippets, met by a class or a word that they share
    kinds = whole.withColumn("score", F.lit(0)).transform(lambda d: _first(d, k, ["cwe", "words"])).select("rid", "pid", "place", "n", "cwe", "words")
    shared = lambda cwe, words: F.concat(F.filter(F.array(cwe), lambda c: c.isNotNull()), F.filter(F.array(*[F.when(words.bitwiseAND(1 << i) > 0, F.lit(str(i))) for i in range(len(_WORDS))]), lambda w: w.isNotNull()))
    profiles = asked.select("suspected", "mine").distinct().withColumn("meets", F.explode(shared(F.col("suspected"), F.col("mine"))))
    kinds = kinds.withColumn("meets", F.explode(shared(F.col("cwe"), F.col("words"))))
    plain = profiles.join(kinds, "meets").drop("meets").distinct().withColumn("score", score(F.lit(0)))
    plain = _first(plain, k, ["suspected", "mine"]).drop("_at", "cwe", "words")
    same = F.col("a.suspected").eqNullSafe(F.col("p.suspected")) & (F.col("a.mine") == F.col("p.mine"))
    by_kind = asked.select("key", "suspected", "mine").alias("a").join(plain.alias("p"), same).select("a.key", "p.rid", "p.pid", "p.place", "p.n", "p.score")

    # by rules: triples that both sides hold
    told = ["rid", "pid", "place", "n", "cwe", "words", "rule", "signature"]
    ruled = whole.where((F.coalesce("rule", F.lit("")) != "") | (F.coalesce("signature", F.lit("")) != ""))
    at = settle(ruled.select("rid", "rule", "signature").mapInArrow(_places, "rid string, at int"), "places")
    known = spark.sparkContext.broadcast(factors.bitmap([r["at"] for r in at.where("at >= 0").select("at").distinct().collect()]))  # at most factors.PLACES numbers
    looked_up = asked.select("key", "folded").mapInArrow(_looked_up(known), "key string, at int")
    pairs = looked_up.join(at.where("at >= 0"), "at").select("key", "rid").distinct()
    pairs = pairs.join(ruled.select(*told), "rid").join(asked, "key")
    # rules that require no literal meet every snippet, in blocks of FREE, with the snippets dealt over all tasks
    free = ruled.join(at.where("at = -1").select("rid"), "rid")
    blocks, tasks = max(1, -(-free.count() // FREE)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    listed = free.select(number("rid", blocks).alias("block"), F.struct(*told).alias("r")).groupBy("block").agg(F.collect_list("r").alias("rules")).withColumn("task", every(tasks))
    met = asked.withColumn("block", every(blocks)).withColumn("task", number("key", tasks)).join(listed, ["block", "task"])
    free_pairs = met.select(*asked.columns, F.explode("rules").alias("r")).select(*asked.columns, "r.*")
    columns = ["key", "rid", "pid", "place", "n", "cwe", "words", "suspected", "mine", "rule", "signature", "snippet", "folded"]
    kept = "key string, rid string, pid long, place long, n long, cwe string, words int, suspected string, mine int, points int"
    tried = pairs.select(columns).unionByName(free_pairs.select(columns)).mapInArrow(_tried, kept)
    by_rule = _first(tried.withColumn("score", score(F.col("points"))).select("key", "rid", "pid", "place", "n", "score"), k, ["key"]).drop("_at")

    both = by_kind.unionByName(by_rule).groupBy("key", "rid", "pid", "place", "n").agg(F.max("score").alias("score")).where("score > 0")
    return _lists(_first(both, k, ["key"]).withColumn("negative", -F.col("score")), k)


def matched(snippets: DataFrame, patterns: DataFrame, k: int = BEST) -> DataFrame:
    """snippets (id, snippet, hook_type) and patterns (pid, cwe_id, code_signature, vulnerable_snippet, detection_rule, seen): id, found.

    found is the best k patterns with any score, as (negative score, place, pid): best first, of equal scores the newest
    (largest `seen`, a number), then the smaller pid, null last. A score is 3 for the suspected class, 5 for the rule, 4 for the
    signature, and 1 for each retrieval word that both hold, up to 3. Rules are searched as Python's regular expressions, without
    regard to case; one that does not compile counts as absent. Nulls count as empty texts.
    """
    keyed = _keyed(snippets, ["snippet", "hook_type"])
    return _answers(keyed, _matched(keyed.select("key", "snippet", _mapped(R.HOOK_TYPE_CWE, F.col("hook_type")).alias("suspected")), patterns, k))


def _similar(rows: DataFrame, patterns: DataFrame, k: int, least: float) -> DataFrame:
    """rows (key, v): key, found."""
    points = patterns.select(F.col("pid").cast("long").alias("pid"), F.col("v").cast("array<double>").alias("v"))
    found = vectors.search(rows, points, k, least)
    order = Window.partitionBy("key").orderBy("negative", F.col("pid").asc_nulls_last(), "twin")
    return _lists(found.withColumn("_at", F.row_number().over(order)).withColumn("place", F.lit(0)), k)


def similar(snippets: DataFrame, patterns: DataFrame, k: int = BEST, least: float = 0.3) -> DataFrame:
    """snippets (id, v) and patterns (pid, v): id, found: the k most similar by cosine, of those over `least` (0 or more).

    found is (negative likeness, place, pid), best first, of equal ones the smaller pid, null last. Likeness is 0 where a vector is
    null, empty, zero, holds a null or an infinite number or has another length.
    """
    keyed = _keyed(snippets.select("id", F.col("v").cast("array<double>").alias("v")), ["v"])
    return _answers(keyed, _similar(keyed.select("key", "v"), patterns, k, least))


def listed(found: DataFrame) -> DataFrame:
    """A row for each pattern found: id, rank (from 1), pid, score."""
    return found.select("id", F.posexplode("found").alias("rank", "f")).select("id", (F.col("rank") + 1).alias("rank"), "f.pid", (-F.col("f.negative")).alias("score"))


def retrieve(snippets: DataFrame, patterns: DataFrame, k: int = BEST, semantic: bool = True) -> DataFrame:
    """snippets (id, snippet, hook_type, v) and patterns (of matched(), and v): id, rank, pid.

    Patterns matched by rules come first; where they are fewer than k, similar ones that are not among them follow. A
    snippet without a vector is matched by rules again, of no suspected class. Texts of under LEAST_TEXT letters have none.
    """
    asked = snippets.where(F.length(stripped(F.coalesce("snippet", F.lit("")))) >= LEAST_TEXT)
    asked = asked.select("id", "snippet", "hook_type", *([F.col("v").cast("array<double>").alias("v")] if semantic else []))
    keyed = _keyed(asked, [c for c in asked.columns if c != "id"])
    suspected = _mapped(R.HOOK_TYPE_CWE, F.col("hook_type"))
    rows = keyed.select(F.concat(F.lit("r"), "key").alias("key"), "snippet", suspected.alias("suspected"))
    if semantic:  # a snippet without a vector is looked up twice, in the same pass
        without = keyed.where(F.coalesce(F.size("v"), F.lit(0)) <= 0)
        rows = rows.unionByName(without.select(F.concat(F.lit("a"), "key").alias("key"), "snippet", F.lit(None).cast("string").alias("suspected")))
    pids = lambda found: found.select("key", F.transform("found", lambda f: f["pid"]).alias("pids"))
    by_rule = pids(_matched(rows, patterns, k)).select(F.substring("key", 1, 1).alias("way"), F.expr("substring(key, 2)").alias("key"), "pids")
    lists = by_rule.where("way = 'r'").select("key", "pids", F.lit(0).alias("turn"))
    if semantic:
        more = pids(_similar(keyed.where(F.coalesce(F.size("v"), F.lit(0)) > 0).select("key", "v"), patterns, BEST, 0.3))
        lists = lists.unionByName(more.select("key", "pids", F.lit(1).alias("turn"))).unionByName(by_rule.where("way = 'a'").select("key", "pids", F.lit(1).alias("turn")))
    none = F.array().cast("array<bigint>")
    both = lists.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("pids"))), none).alias("pids"), F.coalesce(F.max(F.when(F.col("turn") == 1, F.col("pids"))), none).alias("more"))
    new = F.filter("more", lambda p: ~F.exists("pids", lambda q: q.eqNullSafe(p)))
    found = _answers(keyed, both.select("key", F.slice(F.concat("pids", new), 1, k).alias("pids")), "pids")
    return found.select("id", F.posexplode("pids").alias("rank", "pid")).select("id", (F.col("rank") + 1).alias("rank"), "pid")


def described(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """found (id, rank, pid) as one text for each id that names its patterns, their code and their fixes, in order."""
    rows = found.join(patterns.select("pid", "pattern_type", "cwe_id", "vulnerable_snippet", "fix_snippet"), "pid")
    fix = F.when(F.coalesce("fix_snippet", F.lit("")) != "", F.concat(F.lit("\n**Fix**: "), F.substring("fix_snippet", 1, 300))).otherwise("")
    head = F.format_string("### Pattern %d: %s (%s)\n**Vulnerable code**:\n```\n%s\n```", F.col("rank"), F.coalesce("pattern_type", F.lit("?")), F.coalesce("cwe_id", F.lit("?")), F.substring(F.coalesce("vulnerable_snippet", F.lit("")), 1, 400))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, fix).alias("text"))))  # at most k for an id
    return rows.groupBy("id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("text"))
