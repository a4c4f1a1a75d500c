"""One JSON file from the rows of any number of tasks.

``df.write.format("json_document").option("path", file)`` takes rows of one text column, each
an element of a list. Tasks write parts beside the file; the commit puts ``head``, the
parts in the order of partitions, and ``tail`` into it, a few MiB at a time. No row passes
through Spark's driver as data, and what failed attempts left goes with the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .formats import open_store


@dataclass
class Part(WriterCommitMessage):
    nth: int
    path: str
    rows: int


class JsonDocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.head, self.tail = options["path"], options.get("head", "["), options.get("tail", "]")
        _, path = open_store(self.target)
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        fs, _ = open_store(self.target)
        context = TaskContext.get()
        fs.create_dir(self.folder, recursive=True)
        path, rows = f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}", 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                out.write((",\n" if rows else "").encode() + row[0].encode())
                rows += 1
        return Part(context.partitionId(), path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = open_store(self.target)
        with fs.open_output_stream(path) as out:
            out.write(self.head.encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.nth):
                out.write(b"\n" if first else b",\n")
                first = False
                with fs.open_input_stream(part.path, compression=None) as own:
                    while data := own.read(4 << 20):
                        out.write(data)
            out.write(("" if first else "\n").encode() + self.tail.encode())
        self._clear(fs)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(open_store(self.target)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self.folder).type != pafs.FileType.NotFound:
            fs.delete_dir(self.folder)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return JsonDocumentWriter(self.options)
