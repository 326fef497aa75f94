"""Captured traffic: who was signed in, logged-in against anonymous answers, and how to check what differs."""

from __future__ import annotations

import json

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import rules as R
from .order import numbered

WIDTH = 50
PLAIN = 2000  # letters kept of a body that is no JSON


def canonical(body: str | None) -> str:
    """JSON with sorted keys; of anything else the first letters without white space around."""
    if not body:
        return ""
    try:
        return json.dumps(json.loads(body), sort_keys=True)
    except (ValueError, RecursionError):
        return body.strip()[:PLAIN]


def pieces(text: str, width: int = WIDTH) -> list[int]:
    """Hashes of a text's distinct pieces of equal width, which do not overlap."""
    return sorted({xxhash.xxh64_intdigest(text[i : i + width]) - (1 << 63) for i in range(0, len(text), width)})


@F.pandas_udf(StringType())
def canonical_json(body: pd.Series) -> pd.Series:
    return body.map(canonical)


@F.pandas_udf(StructType([StructField("size", IntegerType()), StructField("pieces", ArrayType(LongType()))]))
def shape(body: pd.Series) -> pd.DataFrame:
    """Of a canonical body: its length and its pieces."""
    texts = body.map(canonical)
    return pd.DataFrame({"size": texts.map(len), "pieces": texts.map(pieces)})


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of pieces; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of non-overlapping pieces of two bodies, each in canonical form; 0 if either is empty."""
    return likeness(shape(a)["pieces"], shape(b)["pieces"])


def signed_in(headers: Column) -> Column:
    """Headers (a map) that name an authority or a cookie. A request may be signed in and anonymous, or neither."""
    return _told(headers).contains(":authority") | _told(headers).contains("cookie")


def anonymous(headers: Column) -> Column:
    return ~_told(headers).contains("cookie") & ~_told(headers).contains("authorization")


def _told(headers: Column) -> Column:
    return F.lower(F.coalesce(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", "), F.lit("")))


def diff(logged_in: DataFrame, anonymous: DataFrame) -> DataFrame:
    """Both (seq, method, path, status, body, cors): findings by the first rule that applies. Of equal anonymous keys the last counts.

    Bodies become lengths and hashes of their pieces before they meet, so what is shuffled does not grow with a body's JSON form.
    """
    shaped = lambda rows: rows.select("seq", "method", "path", "status", "cors", shape("body").alias("shape"))
    last = shaped(anonymous).groupBy("method", "path").agg(F.max_by(F.struct("status", "shape", "cors"), "seq").alias("an"))
    pairs = shaped(logged_in).join(last, ["method", "path"])
    alike = likeness(F.col("shape.pieces"), F.col("an.shape.pieces"))
    leak = (F.col("status") == 200) & (F.col("an.status") == 200) & (F.col("shape.size") > 0) & (F.col("an.shape.size") > 100) & (alike > 0.7)
    open_ = (F.col("status") == 200) & ~F.col("an.status").isin(401, 403, 302)
    theirs, ours = F.coalesce("an.cors", F.lit("")), F.coalesce("cors", F.lit(""))
    kind = F.when(leak, "BODY_LEAK").when(open_, "STATUS_MISMATCH").when((theirs != ours) & theirs.contains("*"), "HEADER_LEAK")
    found = pairs.withColumn("diff_type", kind).where("diff_type is not null")
    by = lambda leak, status, other: F.when(F.col("diff_type") == "BODY_LEAK", leak).when(F.col("diff_type") == "STATUS_MISMATCH", status).otherwise(other)
    return found.select(
        "seq", "method", "path", by("HIGH", "MEDIUM", "LOW").alias("severity"), by(0, 1, 2).alias("rank"), "diff_type",
        F.col("status").alias("status_in"), F.col("an.status").alias("status_anon"), by(80, 60, 30).alias("guide_score"),
    )


#: Steps of a guide; {path} and {method} are the finding's.
STEPS = {
    "STATUS_MISMATCH": [
        "1. Open {path} in a private window", "2. Compare the signed-in answer with the anonymous one", "3. Judge whether user or business data leaks",
        "4. Sensitive fields leak: high", "5. Public configuration only: normal",
    ],
    "BODY_LEAK": ["1. Request {method} {path} without cookies", "2. Look for fields of users in the answer", "3. Check whether other resources answer too", "4. Keep a capture as evidence"],
    "HEADER_LEAK": ["1. Find out what the endpoint is for", "2. Judge whether its authentication is as intended", "3. Check how it treats its parameters"],
}
TITLES = {"STATUS_MISMATCH": "Authentication anomaly: ", "BODY_LEAK": "Unauthenticated access: ", "HEADER_LEAK": "To be verified: "}


def guides(findings: DataFrame) -> DataFrame:
    """Findings of diff() with the id F1, F2, ... in their order by severity and arrival, a title, a score and steps to verify them."""
    place = numbered(findings, ["rank", "seq"], "_place", ties=["method", "path"])
    pick = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), F.col("diff_type"))
    filled = lambda step: F.replace(F.replace(F.lit(step), F.lit("{path}"), F.col("path")), F.lit("{method}"), F.col("method"))
    steps = pick({k: F.array_join(F.array(*map(filled, v)), "\n") for k, v in STEPS.items()})
    title = F.concat(pick({k: F.lit(v) for k, v in TITLES.items()}), F.col("path"))
    return place.select(F.concat(F.lit("F"), F.col("_place").cast("string")).alias("finding_id"), "seq", "severity", "diff_type", title.alias("title"), F.col("guide_score").alias("confidence"), F.lit(False).alias("auto_verifiable"), steps.alias("steps"))


def traffic_report(messages: DataFrame, target: str = "") -> DataFrame:
    """messages (seq, method, path, headers map, status, body, cors): the lines (part, seq, n, line) of a report on what differs without signing in.

    Parts: how many requests were signed in and anonymous, the differences by severity and arrival, guides to verify them. Details are cut at 80 letters.
    """
    ours, theirs = messages.where(signed_in(F.col("headers"))), messages.where(anonymous(F.col("headers")))
    keep = ["seq", "method", "path", "status", "body", "cors"]
    found = diff(ours.select(keep), theirs.select(keep))
    told = numbered(found, ["rank", "seq"], "_place", ties=["method", "path"])
    tally = messages.agg(F.count_if(signed_in(F.col("headers"))).alias("a"), F.count_if(anonymous(F.col("headers"))).alias("b")).crossJoin(found.agg(F.count("*").alias("c")))  # one row each
    once = lambda part, *lines: tally.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.posexplode(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])).alias("n", "line"))
    each = lambda rows, part, place, lines: rows.select(F.lit(part).alias("part"), place.cast("long").alias("seq"), F.posexplode(lines).alias("n", "line"))
    head = once(1, f"[TRAFFIC_DIFF] target: {target or 'all'}", F.format_string("  Signed-in requests: %d", "a"), F.format_string("  Anonymous requests: %d", "b"), "", F.format_string("  Differences: %d", "c"))
    detail = F.concat(F.col("diff_type"), F.lit(": "), F.col("status_in").cast("string"), F.lit(" signed in, "), F.coalesce(F.col("status_anon").cast("string"), F.lit("no status")), F.lit(" without"))
    differences = each(told, 2, F.col("_place"), F.array(F.format_string("    [%s] %s %s", "severity", "method", "path"), F.concat(F.lit("           "), F.substring(detail, 1, 80), F.lit("..."))))
    guide = guides(found)
    steps = F.transform(F.split("steps", "\n"), lambda s: F.concat(F.lit("      "), s))
    by_hand = F.when(~F.col("auto_verifiable"), F.array(F.lit("      [!] To be verified by hand"))).otherwise(F.array().cast("array<string>"))
    title = F.array(F.concat(F.lit("    ["), "finding_id", F.lit("] "), "title", F.lit(" (confidence: "), F.col("confidence").cast("string"), F.lit("%)")))
    guided = each(guide, 4, F.substring("finding_id", 2, 20), F.concat(title, steps, by_hand))
    return head.unionByName(differences).unionByName(once(3, "", F.format_string("  Guides (%d):", "c"))).unionByName(guided)


def api_endpoints(requests: DataFrame) -> DataFrame:
    """requests (method, path): distinct 'METHOD path' of paths that look like an interface."""
    is_api = F.exists(F.array(*map(F.lit, R.API_PATHS)), lambda p: F.contains(F.col("path"), p))
    return requests.where(is_api).select(F.concat_ws(" ", "method", "path").alias("endpoint")).distinct()


def first_of_each(requests: DataFrame, most: int | None = None) -> DataFrame:
    """requests (seq, method, path with query, ...): the first of each method and path without query; of these the first `most` by seq, if it is given."""
    bare = F.substring_index("path", "?", 1)
    rows = requests.withColumn("bare", bare)
    others = [c for c in rows.columns if c not in ("method", "bare")]
    first = rows.groupBy("method", "bare").agg(F.min_by(F.struct(*others), "seq").alias("_f")).select("method", "bare", "_f.*")
    return first if most is None else first.orderBy("seq", "method", "bare").limit(most)


def auth_headers(requests: DataFrame) -> DataFrame:
    """requests (seq, headers): names of headers that sign in, with how often they occur and a digest of the last value; values are secret and stay out."""
    rows = requests.select("seq", F.explode("headers").alias("name", "value"))
    known = F.exists(F.array(*map(F.lit, R.AUTH_HEADERS)), lambda k: F.contains(F.lower("name"), k))
    return rows.where(known).groupBy("name").agg(F.count("*").alias("n"), F.sha2(F.max_by("value", "seq"), 256).alias("last_sha256"))
