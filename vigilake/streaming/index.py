"""An index of a tree that follows its files: only files that are new or changed are read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import project_index
from ..operators.hooks import language_of
from ..operators.tables import settle
from ..sources.trees import as_text, listing, whole_tree


def changed(files: DataFrame, index: DataFrame) -> DataFrame:
    """files (path, modified, ...) that the index (path, modified) does not hold as they are."""
    return files.join(index.select("path", "modified"), ["path", "modified"], "left_anti")


def refresh(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index (path, modified, variables, imports) with the rows of new and changed files in place of theirs. files: path, modified, content. Files that are gone stay."""
    new = changed(files, index)
    rows = new.select("path", "modified").join(project_index(new), "path")
    return index.join(rows.select("path"), "path", "left_anti").unionByName(rows.select(index.columns))


#: Paths that are given to the reader one by one; of more changed files the tree is read and the others are passed over.
NAMED = 10_000


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def folder_digests(stamps: DataFrame) -> DataFrame:
    """stamps (path, modified, length): folder, own, whole: digests of a folder's own files, and of all below it, the root being "".

    A digest is the number of files and the exclusive or of 128 bits of hashes of path, time and size, so it needs no order and is
    pre-aggregated; a folder without own files has none of its own.
    """
    one = stamps.withColumns({"_a": F.xxhash64("path", "modified", "length"), "_b": F.xxhash64(F.lit(7), "path", "modified", "length"), "_own": folder_of(F.col("path"))})
    parts = F.split(F.col("_own"), "/")
    above = F.when(F.col("_own") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    rows = one.withColumn("folder", F.explode(above))
    digest = lambda some: F.when(F.count(some) > 0, F.concat_ws(".", F.count(some), F.bit_xor(F.when(some.isNotNull(), F.col("_a"))), F.bit_xor(F.when(some.isNotNull(), F.col("_b")))))
    return rows.groupBy("folder").agg(digest(F.when(F.col("folder") == F.col("_own"), 1)).alias("own"), digest(F.lit(1)).alias("whole"))


def sync(spark: SparkSession, root: str, index: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index (path, modified, variables, imports) and the digests of its folders as the tree is now, and the files that were read for it (path, modified).

    The listing alone gives stamps and folder digests. Only folders whose own digest differs are compared file by file; only their new and
    changed files are read; what is gone from them, or with them, leaves the index. Folders that did not change are not looked into.
    """
    stamps = settle(listing(spark, root).withColumn("folder", folder_of(F.col("path"))), "stamps")
    now = settle(folder_digests(stamps), "folders")
    differs = now.select("folder", "own").join(digests.select("folder", F.col("own").alias("was")), "folder", "full").where(~F.col("own").eqNullSafe(F.col("was"))).select("folder")
    mine = index.withColumn("folder", folder_of(F.col("path")))
    new = settle(changed(stamps.join(differs, "folder", "left_semi"), mine.join(differs, "folder", "left_semi")).select("path", "modified"), "changed")
    some = new.limit(NAMED + 1).select("path").collect()
    files = whole_tree(spark, root, [r.path for r in some] if len(some) <= NAMED else None).join(new, ["path", "modified"])
    rows = files.select("path", "modified").join(project_index(files), "path").select(index.columns)
    gone = mine.join(differs, "folder", "left_semi").join(stamps, "path", "left_anti").select("path")
    kept = index.join(gone, "path", "left_anti").join(new.select("path"), "path", "left_anti")
    return settle(kept.unionByName(rows), "index"), now, new


def follow(spark: SparkSession, root: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a stream that gives put() the index rows of files that come into a tree: path, modified, variables, imports."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    files = raw.select("path", F.col("modificationTime").alias("modified"), language_of(F.col("path")).alias("language"), as_text(F.col("content")).alias("content")).where("language is not null")

    def each(batch: DataFrame, number: int) -> None:
        put(batch.select("path", "modified").join(project_index(batch), "path"), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
