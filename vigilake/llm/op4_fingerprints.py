"""Document fingerprints: canonical exact digest, with DataFrame functions only.

The canonical form is NFKC, full case folding, NFKC again, and white-space runs as one space, none at the ends. Its
fingerprint is 128 bits of xxhash64. Inside each bucket of equal digests the canonical bytes are compared (grouped by
digest and bytes, pre-aggregated, so copies never meet one by one); edited texts, which exist only in passing, are
compared inside the buckets by SHA-256. In a bucket that holds different texts a SHA-256 is appended to each, so equal
fingerprints, edited ones too, always mean equal canonical texts. Likeness of two fingerprints is 1 for the same
canonical bytes, else 0.

The document that follows in doc_id order is found without a global sort: the order (doc_id, null last, then a digest
of the text) is cut at quantiles of doc_id, and where many rows share a doc_id at equal steps of the digest. The first
document of each range is also placed at the end of the range before it (the first of all after the last). Rows that are equal
in doc_id and text and more than a range should hold are one row with their number there: each but the last is followed by its like.

Unicode forms come from the JVM's own library, called through the SQL function reflect().

Nulls, ties: a null text is empty. A null doc_id comes after all others; rows that share a doc_id follow each other by
a digest of the text, rows that repeat are documents of their own. Other columns are ignored. A single document is its
own next one. An empty table gives none.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, wide_hash

#: Rows of one doc_id and text that are told as one with their number, if they are more than this and than a quarter of a range.
EQUAL = 1_000
_KEY = "struct<no_id:boolean,id:bigint,tie:bigint>"
_LEAST = -(1 << 63)


def canonical(col: Column) -> Column:
    def form(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), form(col), F.lit(True))
    return F.trim(F.regexp_replace(form(folded), r"(?U)\s+", " "))


def _digest(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def _range_of(cuts: list[tuple], key: Column) -> tuple[Column, Column]:
    """By binary search: how many cuts (sorted) are at most the key, and the last of those."""
    table = F.from_json(F.lit(json.dumps([dict(zip(("no_id", "id", "tie"), c)) for c in cuts])), f"array<{_KEY}>")
    steps = F.lit([1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)])
    fits = lambda at: (at <= len(cuts)) & (F.try_element_at(table, at) <= key)
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    return own, F.try_element_at(table, own)


def _cuts(base: DataFrame, ranges: int) -> list[tuple]:
    """The first keys of about so many ranges of equal size, as they stand in the table."""
    tally = base.agg(F.count("*").alias("n"), F.count_if("key.no_id").alias("none"), F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 100 * ranges).alias("cuts")).first()
    if not tally.n:
        return []
    times = Counter((False, v) for v in tally.cuts or ()) | Counter({(True, 0): -(-ranges * tally.none // tally.n)})
    rough = [(no_id, v, _LEAST + (i << 64) // m) for (no_id, v), m in times.items() for i in range(m)]
    rough = sorted({*rough, (False, _LEAST, _LEAST)})
    own, _ = _range_of(rough, F.col("key"))
    firsts = base.select(own.alias("range"), "key").groupBy("range").agg(F.min("key").alias("key")).collect()
    return sorted((r.key.no_id, r.key.id, r.key.tie) for r in firsts)


def _counted(base: DataFrame, ranges: int, equal: int) -> DataFrame:
    """base with `copies`: rows of one key that are many and equal become one. There are at most 4 * ranges such keys."""
    bound = max(equal, base.count() // (4 * ranges))
    heavy = settle(base.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("key"), "heavy")
    if heavy.isEmpty():
        return base.withColumn("copies", F.lit(1).cast("long"))
    many = base.join(F.broadcast(heavy), "key", "left_semi").groupBy("doc_id", "text", "key").agg(F.count("*").alias("copies"))
    return base.join(F.broadcast(heavy), "key", "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(settle(many, "equal"))


def digests(docs: DataFrame, ranges: int | None = None, equal: int = EQUAL) -> tuple[DataFrame, DataFrame]:
    """Digests of each text, of its edited text and of what follows; and the canonical forms (h1, h2, canon) of all texts."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    base = _counted(base.withColumn("key", key), ranges, equal)
    h1, h2 = wide_hash(F.col("canon"))
    hashed = base.withColumn("canon", canonical(F.col("text"))).withColumns({"h1": h1, "h2": h2})

    cuts = _cuts(base, ranges)
    own, first = _range_of(cuts or [(False, _LEAST, _LEAST)], F.col("key"))
    rows = hashed.select("doc_id", "key", "text", "copies", "h1", "h2", F.unhex(F.sha2("canon", 256)).alias("sha"), own.alias("own"), (first == F.col("key")).alias("is_first"))
    here, before = F.struct(F.col("own").alias("range"), F.lit(False).alias("copy")), F.struct(F.when(F.col("own") > 1, F.col("own") - 1).otherwise(len(cuts)).alias("range"), F.lit(True).alias("copy"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("is_first"), F.array(here, before)).otherwise(F.array(here)))).select("*", "at.range", "at.copy")
    order = Window.partitionBy("range").orderBy("copy", "key")
    follow = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "h1", "h2")}).where("not copy")
    # of copies the last is followed by the next row, all others by one like themselves
    turns = F.when(F.col("copies") > 1, F.array(F.lit(1).cast("long"), F.col("copies") - 1)).otherwise(F.array(F.lit(1).cast("long")))
    follow = follow.select("*", F.posexplode(turns).alias("itself", "times"))
    follow = follow.withColumns({f"next_{c}": F.when(F.col("itself") == 1, F.col(c)).otherwise(F.col(f"next_{c}")) for c in ("text", "h1", "h2")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = follow.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("canon_edited", canonical(F.col("edited")))
    e1, e2 = wide_hash(F.col("canon_edited"))
    edited = edited.withColumns({"e1": e1, "e2": e2})
    same = lambda a1, a2, bytes_: F.when((F.col("h1") == a1) & (F.col("h2") == a2), bytes_().cast("double")).otherwise(0.0)
    mine = edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", "e1", "e2", "sha", F.unhex(F.sha2("canon_edited", 256)).alias("edited_sha"),
        same(F.col("e1"), F.col("e2"), lambda: canonical(F.col("text")) == F.col("canon_edited")).alias("near_edited"),
        same(F.col("next_h1"), F.col("next_h2"), lambda: canonical(F.col("text")) == canonical(F.col("next_text"))).alias("near_next"), "times",
    )
    mine = mine.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_i", "times")
    return mine, hashed.select("h1", "h2", "canon")


def _several(rows: DataFrame, what: str) -> DataFrame:
    """Digests (h1, h2) that stand for more than one `what`."""
    return rows.groupBy("h1", "h2", what).agg(F.count("*")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")


def fingerprints(docs: DataFrame, ranges: int | None = None, equal: int = EQUAL) -> DataFrame:
    """docs (doc_id, text): fingerprint of each text and of its edited text, and their likeness."""
    mine, forms = digests(docs, ranges, equal)
    mine = settle(mine, "fingerprints")
    prints = mine.select("h1", "h2", "sha").unionByName(mine.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("edited_sha").alias("sha")))
    shared = settle(_several(forms, "canon").unionByName(_several(prints, "sha")).distinct(), "shared")
    if shared.isEmpty():  # no digest stands for two texts: nothing to append
        marked = mine.withColumns({"shared": F.lit(False), "edited_shared": F.lit(False)})
    else:
        of_text = shared.select("h1", "h2", F.lit(True).alias("shared"))
        of_edited = shared.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.lit(True).alias("edited_shared"))
        marked = mine.join(of_text, ["h1", "h2"], "left").join(of_edited, ["e1", "e2"], "left")
    told = lambda shared, sha: F.when(F.col(shared), F.concat(F.lit("-"), F.lower(F.hex(sha)))).otherwise("")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat(_digest(F.col("h1"), F.col("h2")), told("shared", "sha")).alias("fingerprint"),
        F.concat(_digest(F.col("e1"), F.col("e2")), told("edited_shared", "edited_sha")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
