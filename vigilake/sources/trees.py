"""Source trees, captured exchanges and third-party scanner reports as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.agents import hook_id
from ..operators.hooks import language_of
from .elements import json_elements

MOST_KB = 500
LISTED = 50


def _any_case(ending: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)


def _files(spark: SparkSession, root: str, endings: list[str], named: list[str] | None = None) -> DataFrame:
    """Files below a root whose names have one of the endings, which the listing itself sees to: path (below root), length, modified, content. named: only these paths below the root."""
    at = root if named is None else [re.sub(r"([\\{}\[\]*?])", r"\\\1", f"{root.rstrip('/')}/{p}") for p in named]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(map(_any_case, endings)) + "}")
    files = reader.load(at) if at else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    below = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/" if root.strip("/") else "/"
    return files.select(F.substring(below, len(prefix) + 1, 1 << 20).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def as_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def source_tree(spark: SparkSession, root: str, max_kb: int = MOST_KB, endings: list[str] | None = None) -> DataFrame:
    """Files of a tree: path (below root), language, length, modified, content as text.

    Names are chosen by the listing and sizes by the scan, before contents are read; folders that are excluded by name
    (only those below the root) and minified files are left out after it. Files of any bytes are read.
    """
    rows = _files(spark, root, endings or list(R.LANGUAGES)).where(F.col("length") <= max_kb * 1024)
    rows = rows.withColumn("language", language_of(F.col("path"))).where("language is not null")
    folders = F.split(F.lower(F.regexp_replace("path", r"/?[^/]*$", "")), "/")
    rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, R.EXCLUDED_DIRS))) & ~F.lower(F.substring_index("path", "/", -1)).contains(".min."))
    return rows.select("path", "language", "length", "modified", as_text(F.col("content")).alias("content"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), modified and length of the source files of a tree; their contents are not read."""
    return _files(spark, root, list(R.LANGUAGES)).select("path", "modified", "length")


def whole_tree(spark: SparkSession, root: str, named: list[str] | None = None) -> DataFrame:
    """Files of a tree of any size and in any folder: what chunks are made of. named: only these paths below the root."""
    rows = _files(spark, root, list(R.LANGUAGES), named).withColumn("language", language_of(F.col("path"))).where("language is not null")
    return rows.select("path", "language", "length", "modified", as_text(F.col("content")).alias("content"))


def php_bytes(spark: SparkSession, root: str) -> DataFrame:
    """PHP files of a tree as they are: project (the root), path, content."""
    return _files(spark, root, ["php"]).select(F.lit(root).alias("project"), "path", "content")


def file_list(files: DataFrame, n: int = LISTED) -> DataFrame:
    """files (path, length): the first n by path, a line each."""
    return files.select("path", F.format_string("  %s (%d bytes)", "path", F.col("length").cast("long")).alias("line")).orderBy("path").limit(n)


_HEADERS = "array<struct<name:string,value:string>>"
_HAR = f"request struct<method:string,url:string,headers:{_HEADERS},postData:struct<text:string>>,response struct<status:int,content:struct<size:bigint>>"
_PROXY = f"request struct<method:string,url:string,headers:{_HEADERS},body:string>,response struct<status:int,headers:{_HEADERS},body:string>"


def last_headers(headers: Column) -> Column:
    """A map of headers; of those with one name the last counts."""
    put = lambda m, h: F.map_concat(F.map_filter(m, lambda k, _: k != h["name"]), F.create_map(h["name"], h["value"]))
    named = F.filter(F.coalesce(headers, F.array().cast(_HEADERS)), lambda h: h["name"].isNotNull())
    return F.aggregate(named, F.create_map().cast("map<string,string>"), put)


def netloc(url: Column) -> Column:
    """Host and port of an address."""
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)


def har(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """Entries of HAR files in order; seq is unique over all files, and a file of any size is read by many tasks. Of headers with one name the last counts."""
    e = json_elements(spark, path, ("log", "entries")).select("seq", F.from_json("text", _HAR).alias("e")).select("seq", "e.*")
    rows = e.select(
        "seq", "request.method", "request.url", F.regexp_extract("request.url", r"^https?://[^/?#]*([^#]*)", 1).alias("path"), last_headers(F.col("request.headers")).alias("headers"),
        F.col("request.postData.text").alias("post_data"), "response.status", F.coalesce("response.content.size", F.lit(0)).alias("size"),
    )
    return rows.where(F.col("url").contains(domain)) if domain else rows


def proxy_export(spark: SparkSession, path: str, url_filter: str = "", limit: int = 500) -> DataFrame:
    """Messages of exported proxy histories: the first `limit` of each file whose address holds the filter."""
    some = json_elements(spark, path, ("messages",)).select("file", "seq", F.from_json("text", _PROXY).alias("m"))
    some = some.where(F.contains(F.coalesce("m.request.url", F.lit("")), F.lit(url_filter)))
    m = some.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("seq"))).where(F.col("_n") <= limit).select("seq", "m.*")
    url = F.coalesce("request.url", F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    return m.select(
        "seq", F.coalesce("request.method", F.lit("GET")).alias("method"), url.alias("url"), netloc(url).alias("host"), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        last_headers(F.col("request.headers")).alias("headers"), text("request.body").alias("body"), F.coalesce("response.status", F.lit(0)).alias("status"),
        last_headers(F.col("response.headers")).alias("response_headers"), text("response.body").alias("response_body"),
    )


_SAST = "check_id string,path string,start struct<line:int>,end struct<line:int>,extra struct<severity:string,lines:string,message:string,metadata:struct<cwe:array<string>,owasp:array<string>,source:string>>"


def sast_rows(raw: DataFrame) -> DataFrame:
    """raw (results as in a scanner's report) as hooks; of equal (path, start, end, check) the first counts."""
    return _sast_hooks(raw.select(F.posexplode("results").alias("seq", "r")))


def _sast_hooks(rows: DataFrame) -> DataFrame:
    """rows (seq, r), r as in _SAST."""
    level = F.create_map(*[F.lit(x) for x in ("ERROR", "high", "WARNING", "medium", "INFO", "low")])
    check, extra = F.coalesce("r.check_id", F.lit("unknown")), F.col("r.extra")
    message = F.coalesce(extra["message"], F.lit(""))
    none = F.array().cast("array<string>")
    told = F.struct(
        check.alias("check_id"), message.alias("risk_reason"), F.coalesce(extra["severity"], F.lit("")).alias("semgrep_severity"), F.coalesce(extra["metadata"]["cwe"], none).alias("cwe"),
        F.coalesce(extra["metadata"]["owasp"], none).alias("owasp"), F.coalesce(extra["metadata"]["source"], F.lit("")).alias("source_rule"),
    )
    path, func, line = F.coalesce("r.path", F.lit("")), F.substring_index(check, ".", -1), F.col("r.start.line")
    flat = rows.select(
        "seq", hook_id(path, func, line).alias("hook_id"), path.alias("path"), line.alias("line_start"), F.col("r.end.line").alias("line_end"), check.alias("check_id"), func.alias("func_name"),
        F.lit("semgrep").alias("hook_type"), F.lit("python").alias("language"), F.coalesce(F.try_element_at(level, F.upper(extra["severity"])), F.lit("info")).alias("severity"),
        F.when(F.coalesce(extra["lines"], F.lit("")) != "", extra["lines"]).otherwise(F.substring(message, 1, 500)).alias("snippet"), F.to_json(told).alias("metadata"),
        F.lit("pending").alias("status"), F.lit(30.0).alias("confidence"),
    )
    key = ["path", "line_start", "line_end", "check_id"]
    return flat.groupBy(*key).agg(F.min_by(F.struct(*[c for c in flat.columns if c not in (*key, "seq")]), "seq").alias("f")).select(*key, "f.*")


def sast_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of scanner reports as hooks; of equal ones the first in the order of files and places counts."""
    return _sast_hooks(json_elements(spark, path, ("results",)).select("seq", F.from_json("text", _SAST).alias("r")))
