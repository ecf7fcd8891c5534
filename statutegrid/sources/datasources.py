"""Python data sources: documents of any kind as planned partitions, and workbooks, one a document, written by the executors.

    register(spark)
    units = spark.read.format("statutegrid-documents").load("/rules")          # units of text, unreadable files with their reason
    rows.write.format("statutegrid-workbooks").mode("append").save("/out")     # see `write_workbooks`, which deals rows out first

Both open files by pyarrow's file systems (local, HDFS, S3, GCS), on the executors; the driver lists names and sizes only.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from statutegrid.functions.ship import ship
from statutegrid.functions.spread import by_document
from statutegrid.operators.blocks import markdown_blocks, paragraphs
from statutegrid.operators.pipeline import base_name
from statutegrid.operators.review import COLUMNS, TRIGGER
from statutegrid.operators.review import table as table_of
from statutegrid.sources.readers import SUFFIXES, docx_paragraphs, pdf_pages
from statutegrid.sources.sinks import Workbook

UNITS = "path string, suffix string, length long, unit_no int, page int, text string, error string"
#: A partition ends behind so many bytes of files, or so many files.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, bytes)."""

    files: list[tuple[str, int]]


#: What a pushed filter asks of a file, before it is opened.
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


class DocumentReader(DataSourceReader):
    """Files under a path in partitions of near-equal bytes; filters on path, suffix and length leave files out before they are opened."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("statutegrid-documents: load(path) names a file or a folder")
        self.root = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, IsNotNull) and column in (("path",), ("suffix",), ("length",)):
                continue  # every file has them
            if type(f) in _TESTS and column in (("path",), ("suffix",), ("length",)):
                self.wanted.append((type(f), column[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = file_system(self.root)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {self.root}")
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        prefix = self.root.split("://")[0] + "://" if "://" in self.root else ""
        files = [(prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        out: list[Files] = []
        size = self.most
        for path, n in sorted(f for f in files if self.takes(*f)):
            if size + n > self.most or len(out[-1].files) >= PARTITION_FILES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, n))
            size += n
        return out or [Files([])]

    def takes(self, path: str, length: int) -> bool:
        own = {"path": path, "suffix": _suffix(path), "length": length}
        return all(_TESTS[kind](own[column], value) for kind, column, value in self.wanted)

    def opened(self, path: str) -> bytes:
        system, inside = file_system(path)
        with system.open_input_stream(inside) as f:
            return f.read()

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.files:
            kind = _suffix(path)
            row = lambda unit, page, text, error: (path, kind, length, unit, page, text, error)  # noqa: E731, B023
            if kind not in SUFFIXES:
                yield row(None, None, None, "legacy .doc files are not read; convert to .docx first" if kind == ".doc" else f"type {kind!r} is none of {', '.join(SUFFIXES)}")
                continue
            try:
                units = _units(kind, self.opened(path))
            except Exception as problem:  # whatever a broken file does to its parser is that file's reason
                yield row(None, None, None, f"{type(problem).__name__}: {problem}"[:500])
                continue
            for n, (page, text) in enumerate(units):
                yield row(n, page, text, None)


def _suffix(path: str) -> str:
    return os.path.splitext(path.rsplit("/", 1)[-1])[1].lower()


def _units(kind: str, content: bytes) -> list[tuple[int | None, str]]:
    if kind == ".docx":
        return [(None, t) for t in docx_paragraphs(content)]
    if kind == ".pdf":
        return [(n, t) for n, t in enumerate(pdf_pages(content), 1)]
    return [(None, content.decode("utf-8", "replace"))]


class Documents(DataSource):
    """spark.read.format("statutegrid-documents"): one row a unit of text, one row a file that cannot be read."""

    @classmethod
    def name(cls) -> str:
        return "statutegrid-documents"

    def schema(self) -> str:
        return UNITS

    def reader(self, schema: object) -> DocumentReader:
        return DocumentReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written: (where it is, where it goes)."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceArrowWriter):
    """Rows of one document after another as one workbook each, and a JSON sidecar where rows have spans.

    Tasks write under names of their own in a hidden folder; only when all have ended well do the files that they tell of go to their places, so no reader
    meets half a workbook or half a job, and a task that runs again or twice does no harm.
    """

    def __init__(self, options: dict[str, str], overwrite: bool, names: list[str]):
        if "path" not in options:
            raise ValueError("statutegrid-workbooks: save(path) names a folder")
        missing = [c for c in ("doc_id", *COLUMNS) if c not in names]
        if missing:
            raise ValueError(f"statutegrid-workbooks: no column {missing[0]}")
        self.root, self.overwrite, self.spans = options["path"].rstrip("/"), overwrite, "spans" in names
        self.stage = f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.root)
        system.create_dir(f"{root}/{self.stage}", recursive=True)
        done: list[tuple[str, str]] = []
        book: Workbook | None = None
        technical_: dict = {}
        at, seen, target = None, set(), ""

        def put(name: str, content: Callable[[BinaryIO], object]) -> None:
            own = f"{root}/{self.stage}/{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                content(out)
            done.append((own, f"{root}/{name}"))

        def close() -> None:
            if book is not None:
                put(f"{target}.xlsx", book.finish)
                if self.spans:
                    put(f"{target}_technical.json", lambda out: out.write(json.dumps(technical_, ensure_ascii=False, indent=1, default=str).encode()))

        for batch in iterator:
            for row in batch.to_pylist():
                if book is None or row["doc_id"] != at:
                    close()
                    at = row["doc_id"]
                    if at in seen:
                        raise ValueError("a document's rows are not together; see write_workbooks")
                    seen.add(at)
                    stem = os.path.splitext((row["source_base"] or "document").rsplit("/", 1)[-1])[0]
                    target = f"{stem}-{hashlib.md5(str(at).encode()).hexdigest()[:8]}_paso1"
                    book, technical_ = Workbook(), {}
                book.add(tuple(row[c] for c in COLUMNS))
                if self.spans:
                    technical_[row["segment_id"]] = {"spans": row["spans"], "confidence": row.get("confidence")}
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.root)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite and system.get_file_info(root).type == pafs.FileType.Directory:
            for old in system.get_file_info(pafs.FileSelector(root)):
                if old.type == pafs.FileType.File:
                    system.delete_file(old.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(*f), files))
        self._unstage(system, root)
        counts = Counter(os.path.splitext(target)[1] for _, target in files)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps(dict(sorted(counts.items()))).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._unstage(*file_system(self.root))

    def _unstage(self, system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class Workbooks(DataSource):
    """df.write.format("statutegrid-workbooks"): doc_id and the 21 columns, a document's rows together and in order; spans and confidence make sidecars."""

    @classmethod
    def name(cls) -> str:
        return "statutegrid-workbooks"

    def writer(self, schema: object, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, overwrite, list(schema.names))


def register(spark: SparkSession) -> None:
    """Both sources for this session; filters reach the reader."""
    ship(spark)
    spark.dataSource.register(Documents)
    spark.dataSource.register(Workbooks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_reported(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, unreadable): blocks as `readers.read_blocks` gives them, and (doc_id, source_base, reason) for each file that cannot be read.

    A missing path raises; a broken file, an unknown type and a file whose parser is not installed are rows with their reason, and stop nothing else.
    """
    register(spark)
    units = spark.read.format(Documents.name()).load(path)
    form = F.col("suffix")
    parts: Column = F.when(form == ".md", markdown_blocks(F.col("text"))).when(form == ".docx", F.array("text")).otherwise(paragraphs(F.col("text")))
    whole = by_document(units.where(form.isin(*SUFFIXES) & F.col("error").isNull()), "path")
    spread = whole.select("path", "unit_no", "page", F.posexplode(parts).alias("part_no", "text"))
    blocks = spread.select(
        F.col("path").alias("doc_id"), base_name(F.col("path")).alias("source_base"), (F.shiftleft(F.col("unit_no").cast("long"), 32) + F.col("part_no")).alias("block_no"), "page", "text"
    )
    return blocks, units.where("error IS NOT NULL").select(F.col("path").alias("doc_id"), base_name(F.col("path")).alias("source_base"), F.col("error").alias("reason"))


def write_workbooks(
    rows: DataFrame, path: str, with_technical: bool = True, mode: str = "append", system: str | None = None, case: int | None = None, model_version: str | None = None
) -> None:
    """Analysed rows (`operators/pipeline.py: analysed`) of any number of documents as one workbook each, built on the executors; sidecars beside them.

    Documents are dealt out whole and streamed row by row; nothing comes to the driver but the names of the files.
    """
    register(rows.sparkSession)
    whole = table_of(rows, system, case, model_version, "triggers", "confidence")
    spans = [F.col("triggers").cast(TRIGGER).alias("spans"), F.col("confidence")] if with_technical else []
    dealt = whole.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "segment_order")
    dealt.select("doc_id", *COLUMNS, *spans).write.format(Workbooks.name()).mode(mode).save(path)
