"""One ordered document of a sorted table: a file, not a folder of parts.

A Python data source whose tasks write the lines of their partition to a part of their own and report its place, size and
lines; the commit puts the parts together in the order of partitions under another name and renames it, so the document is there as a whole or not at
all. Lost tasks and second attempts leave parts that no message names. Parts are streamed through the commit in blocks of
BLOCK bytes, as one file has one writer; nothing of a document is held but a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "vigilake_document"
BLOCK = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    place: int
    path: str
    size: int
    lines: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        place = TaskContext.get().partitionId()
        store, path = _store(self.path)
        part = f"{path}.{self.run}-parts/{place}-{uuid.uuid4().hex}"
        store.create_dir(part.rpartition("/")[0], recursive=True)
        size = lines = 0
        with store.open_output_stream(part) as out:
            for row in rows:
                if row[0] is not None:
                    size += out.write(row[0].encode() + b"\n")
                    lines += 1
        return Part(place, part, size, lines)

    def _clear(self) -> None:
        store, path = _store(self.path)
        folder = f"{path}.{self.run}-parts"
        if store.get_file_info(folder).is_file is False and store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)

    def commit(self, messages: list[Part | None]) -> None:
        store, path = _store(self.path)
        whole = f"{path}.{self.run}-whole"
        with store.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m and m.size), key=lambda m: m.place):
                with store.open_input_stream(part.path) as source:
                    while block := source.read(BLOCK):
                        out.write(block)
        store.move(whole, path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_document(lines: DataFrame, path: str) -> None:
    """lines (part, seq, n, line) as one text file at path, which it replaces; null lines are left out."""
    spark = lines.sparkSession
    spark.dataSource.register(Document)
    lines.orderBy("part", "seq", "n", "line").select("line").write.format(FORMAT).mode("append").save(path)
