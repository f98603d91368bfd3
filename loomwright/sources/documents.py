"""A sink that leaves whole documents: tasks write staged files, and only what is committed gets a name that readers look for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Staged(WriterCommitMessage):
    #: (order, file, rows) of each file that a task has written.
    files: list[tuple[int, str, int]]


class DocumentWriter(DataSourceArrowWriter):
    """Options: path, suffix, before, behind, and shape. Rows are (line): each task writes a file of lines, framed by before and behind
    (shape each), by before in the first file alone (shape first), or not at all until commit joins all of them to one document (shape
    one). Or rows are (part, book), and each is a file of its own (shape books)."""

    def __init__(self, options: dict[str, str]):
        self.system, self.folder = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.shape, self.suffix = options.get("shape", "each"), options["suffix"]
        self.before, self.behind = (options.get(k, "").encode() for k in ("before", "behind"))
        self.staging = f"{self.folder}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        part = TaskContext.get().partitionId()
        self.system.create_dir(self.staging)
        named = lambda n: f"{self.staging}/{n:09d}-{uuid.uuid4().hex}"
        if self.shape == "books":
            files = []
            for batch in iterator:
                for number, book in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    files.append((number, named(number), 1))
                    with self.system.open_output_stream(files[-1][1]) as out:
                        out.write(book.as_buffer())
            return _Staged(files)
        path, rows = named(part), 0
        with self.system.open_output_stream(path) as out:
            if self.shape == "each" or self.shape == "first" and part == 0:
                out.write(self.before)
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                out.write("".join(f"{line}\n" for line in lines if line is not None).encode())
                rows += len(lines)
            if self.shape == "each":
                out.write(self.behind)
        return _Staged([(part, path, rows)])

    def commit(self, messages: list[_Staged | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        if self.shape == "one":
            with self.system.open_output_stream(f"{self.staging}/whole") as out:
                out.write(self.before)
                for _, path, _ in files:
                    with self.system.open_input_stream(path) as part:
                        while piece := part.read(1 << 20):
                            out.write(piece)
                out.write(self.behind)
            files = [(0, f"{self.staging}/whole", 1)]
        full = [f for i, f in enumerate(files) if f[2] or i == 0 and (self.shape == "first" or not any(g[2] for g in files))]
        for i, (_, path, _) in enumerate(full):
            self.system.move(path, f"{self.folder}/part-{i:05d}.{self.suffix}")
        self.system.delete_dir(self.staging)

    def abort(self, messages: list[_Staged | None]) -> None:
        if self.system.get_file_info(self.staging).type == fs.FileType.Directory:
            self.system.delete_dir(self.staging)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_documents(rows: DataFrame, path: str, suffix: str, shape: str = "each", before: str = "", behind: str = "") -> None:
    """Writes lines or books as documents under path (a folder that executors share), part-00000 and so on in the order of the rows' partitions. A task that fails, or is run
    twice, leaves nothing; a table without rows is a document of its frame. An existing folder is added to only where names don't clash,
    so give each export one of its own."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    rows.write.format(DocumentSource.name()).mode("append").options(path=path, suffix=suffix, shape=shape, before=before, behind=behind).save()
