"""PHP files that are encrypted or obfuscated, by what their first line holds, and whether a tree is worth an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the published check looks for.
SIGNATURES = ["SourceGuardian", "php_screw", "ionCube", "Zend Guard", "eval(base64_decode"]
FIRST_BYTES, MOST_FILES, MOST_SAMPLES = 200, 500, 10
TYPE_FILES, TYPE_BYTES = 5, 500
RISKY, SKIP = 0.10, 0.30


def _letters(part: Column) -> Column:
    """Bytes as letters, one for each, whatever they are."""
    return F.decode(part, "ISO-8859-1")


def first_line(content: Column) -> Column:
    """The first bytes of a file's first line, as letters."""
    return F.substring_index(_letters(F.substring(content, 1, FIRST_BYTES)), "\n", 1)


def is_encrypted(content: Column) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, SIGNATURES)), lambda s: F.contains(first_line(content), s)), F.lit(False))


def encryption_report(files: DataFrame) -> DataFrame:
    """files (project, path, content binary): for each project its PHP files, how many of the first MOST_FILES by path are encrypted, and a verdict.

    The ratio is over all PHP files, as the published check has it. The kind is the first signature in the first bytes of the
    first files. A project without PHP files is safe.
    """
    php = F.lower("path").endswith(".php")
    rows = files.where(php).select("project", "path", "content")
    totals = files.groupBy("project").agg(F.count_if(php).alias("total_files"))
    judged = rows.join(_first_paths(rows), ["project", "path"]).select("project", "path", "place", is_encrypted(F.col("content")).alias("encrypted"), _kind(F.substring("content", 1, TYPE_BYTES)).alias("kind"))
    found = judged.groupBy("project").agg(
        F.count_if("encrypted").alias("encrypted_files"), F.min_by("kind", F.when(F.col("kind").isNotNull() & (F.col("place") <= TYPE_FILES), F.col("place"))).alias("kind"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("encrypted"), F.col("path")))), 1, MOST_SAMPLES), ",").alias("samples"),
    )  # at most MOST_FILES of a project are judged
    joined = totals.join(found, "project", "left")
    encrypted = F.coalesce("encrypted_files", F.lit(0))
    ratio = encrypted / F.greatest("total_files", F.lit(1))
    verdict = F.when(ratio >= SKIP, "skip").when(ratio >= RISKY, "risky").otherwise("safe")
    return joined.select("project", "total_files", encrypted.alias("encrypted_files"), F.round(ratio, 6).alias("ratio"), F.coalesce("kind", F.lit("none")).alias("kind"), verdict.alias("verdict"), F.coalesce("samples", F.lit("")).alias("samples"))


def _kind(part: Column) -> Column:
    return F.try_element_at(F.filter(F.array(*map(F.lit, SIGNATURES)), lambda s: F.contains(_letters(part), s)), F.lit(1))


def _first_paths(rows: DataFrame) -> DataFrame:
    """project, path and place of the first files by path: found slot by slot, so that no project is one task."""
    slot = F.pmod(F.xxhash64("path"), F.lit(64))
    paths = rows.select("project", "path").distinct().withColumn("slot", slot)
    some = paths.withColumn("n", F.row_number().over(Window.partitionBy("project", "slot").orderBy("path"))).where(F.col("n") <= MOST_FILES)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("path"))).where(F.col("place") <= MOST_FILES).select("project", "path", "place")
