"""Stored tables by key: files in buckets, versions that are whole or not there, and changes that rewrite only the buckets they touch.

A row lies in the bucket that its key's hash names. A version is a manifest: for each bucket the folder that holds it. A change reads the
buckets of its keys, writes them anew beside the old ones and then commits a manifest that names the new folders for these and the
old ones for all others. The commit is the creation of one marker file that must not exist yet: of two writers that started from the
same version one commits, the other raises Conflict (or starts again, `tries`). Until the marker stands readers see the version
before, whatever tasks are lost. Old folders stay until remove_before().

Files are reached through Hadoop's file systems, as Spark reaches them. The driver holds one short entry for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first."""


class _Files:
    """The few calls that are needed of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = lambda *parts: self.jvm.org.apache.hadoop.fs.Path("/".join((root, *parts)))
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, text: str, *parts: str) -> None:
        """A new file; fails if it is there."""
        out = self.fs.create(self.path(*parts), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, *parts: str) -> str:
        source = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


class KeyedTable:
    """A stored table with a key. Rows without any of the key's columns are refused."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path.rstrip("/"))
        self.refresh(version)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> KeyedTable:
        """Version 1: rows, of which each key has one."""
        spark = rows.sparkSession
        files = _Files(spark, path.rstrip("/"))
        first = {"version": 0, "key": key, "n": buckets, "schema": rows.schema.json(), "buckets": {}}
        cls._commit(files, first)
        table = cls(spark, path)
        table._write(rows, list(range(buckets)))
        return table

    @staticmethod
    def _commit(files: _Files, manifest: dict) -> None:
        name = f"{uuid.uuid4().hex}.json"
        files.put(json.dumps(manifest), "manifests", name)
        try:
            files.put(name, "versions", f"{manifest['version']:012d}")
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names("versions") if n.isdigit()]

    def refresh(self, version: int | None = None) -> KeyedTable:
        """Looks at the newest version, or the one named. A marker whose writer died before it was filled counts for nothing."""
        for n in [version] if version is not None else sorted(self.versions(), reverse=True):
            if name := self.files.get("versions", f"{n:012d}"):
                self.manifest = json.loads(self.files.get("manifests", name))
                return self
        raise FileNotFoundError(f"no table at {self.path}")

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest["schema"]))

    def _folders(self, buckets: list[int] | None = None) -> list[str]:
        known = self.manifest["buckets"]
        wanted = known.values() if buckets is None else [known[str(b)] for b in buckets if str(b) in known]
        return [f"{self.path}/{folder}" for folder in wanted]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of this version, or of some of its buckets."""
        folders = self._folders(buckets)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.manifest["key"]), F.lit(self.manifest["n"])).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most one for each bucket

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        whole = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        for k in self.manifest["key"]:
            whole = whole.where(F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a row without {k}")).cast("boolean")).otherwise(True))
        folder = f"data/{uuid.uuid4().hex}"
        whole.withColumn("_bucket", self.bucket()).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {int(n.split("=")[1]) for n in self.files.names(folder) if n.startswith("_bucket=")}
        kept = {b: f for b, f in self.manifest["buckets"].items() if int(b) not in touched}
        newer = [n for n in self.versions() if n > self.manifest["version"]]
        if any(self.files.get("versions", f"{n:012d}") for n in newer):
            raise Conflict(f"version {self.manifest['version']} is not the newest any more")
        number = max([self.manifest["version"], *newer]) + 1  # behind markers that were never filled
        new = self.manifest | {"version": number, "buckets": kept | {str(b): f"{folder}/_bucket={b}" for b in sorted(written)}}
        self._commit(self.files, new)
        self.manifest = new

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], tries: int) -> KeyedTable:
        for left in range(tries, 0, -1):
            try:
                touched = self._touched(rows)
                if touched:
                    self._write(merge(self.read(touched)), touched)
                return self
            except Conflict:
                if left == 1:
                    raise
                self.refresh()
        return self

    def upsert(self, rows: DataFrame, seq: Column, tries: int = 1) -> KeyedTable:
        """Whole rows replace those with their key; of several with one key the last by seq."""
        key, columns = self.manifest["key"], [f.name for f in self.schema.fields]
        others = [c for c in columns if c not in key]
        new = rows.select(*columns, seq.alias("_seq")).withColumn("_new", F.lit(True))

        def merge(old: DataFrame) -> DataFrame:
            both = old.withColumns({"_seq": F.lit(None).cast(new.schema["_seq"].dataType), "_new": F.lit(False)}).unionByName(new)
            last = both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("_new", "_seq")).alias("_r"))
            return last.select(*key, "_r.*")

        return self._change(rows, merge, tries)

    def update(self, changes: DataFrame, columns: list[str], tries: int = 1) -> KeyedTable:
        """Values of changes (key, columns; one row for each key) that are not null replace those of the rows with their key; other keys match nothing."""
        key = self.manifest["key"]
        new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
        return self._change(changes, lambda old: old.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}), tries)

    def remove_before(self, version: int) -> None:
        """Gives up the versions before one, and the folders that only they name."""
        kept = [KeyedTable(self.spark, self.path, n).manifest for n in self.versions() if n >= version]
        folders = {f.split("/")[1] for m in kept for f in m["buckets"].values()}
        for n in self.versions():
            if n < version:
                self.files.remove("versions", f"{n:012d}")
        for name in self.files.names("data"):
            if name not in folders:
                self.files.remove("data", name)
