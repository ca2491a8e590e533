"""A report as a sink: parts in order, written by tasks and published at once.

The sink is a Python data source. A task writes its part under a name of its own attempt; the commit renames the parts of
the tasks that count, in their order, and lists them in the report's first page; after a failure the parts are taken away. The driver
sees names and sizes only. Paths may be of any file system that pyarrow reaches from driver and executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEAD = "report.md"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, overwrite: bool) -> None:
        self.path, self.head, self.overwrite, self.job = path, head, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = place(self.path)
        system.create_dir(f"{root}/_parts-{self.job}", recursive=True)
        name, rows = f"{root}/_parts-{self.job}/{task.partitionId()}-{task.taskAttemptId()}.md", 0
        with system.open_output_stream(name) as out:
            for batch in batches:
                for text in batch.column(0):
                    out.write((text.as_py() or "").encode(errors="surrogatepass") + b"\n")
                    rows += 1
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = place(self.path)
        if self.overwrite:
            for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if found.is_file and found.extension == "md":
                    system.delete_file(found.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        lines = []
        for k, part in enumerate(parts):
            system.move(part.name, f"{root}/part-{k:05d}.md")
            lines.append(f"{k + 1}. [part-{k:05d}.md](part-{k:05d}.md): {part.rows} documents")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{HEAD}") as out:
            out.write((self.head + "\n## Documents\n\n" + "\n".join(lines) + "\n").encode())
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = place(self.path)
        if system.get_file_info(f"{root}/_parts-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_parts-{self.job}")


class Report(DataSource):
    """format('report'): one column of texts, in the order of the partitions; options path and head (text before the list of parts)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("a report has one column of strings")
        return Writer(self.options["path"], self.options.get("head", ""), overwrite)


def write(rows: DataFrame, path: str, key: str, text: str, head: str) -> None:
    """The texts under path in the order of key, as parts, and HEAD, which lists them behind the head; earlier parts go."""
    rows.sparkSession.dataSource.register(Report)
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).select(text)
    ordered.write.format("report").option("head", head).mode("overwrite").save(path)


def remove(path: str) -> None:
    system, root = place(path)
    system.delete_dir(root)
