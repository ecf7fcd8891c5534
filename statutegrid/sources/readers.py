"""Documents from files: text and Markdown natively, Word by the standard library, PDF where a reader is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.functions.spread import by_document
from statutegrid.operators.blocks import markdown_blocks, paragraphs
from statutegrid.operators.pipeline import base_name

SUFFIXES = (".pdf", ".docx", ".txt", ".md")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedDocument(ValueError):
    """A file of a type that no reader takes."""


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the body's own paragraphs; tables, headers and footers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    out = []
    for p in body.findall(f"{_WORD}p") if body is not None else []:
        parts = []
        for node in p.iter():
            if node.tag == f"{_WORD}t":
                parts.append(node.text or "")
            elif node.tag == f"{_WORD}tab":
                parts.append("\t")
            elif node.tag in (f"{_WORD}br", f"{_WORD}cr"):
                parts.append("\n")
        if text := "".join(parts).strip():
            out.append(text)
    return out


def pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ImportError("pypdf is needed to read PDF documents") from None
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word paragraphs as they are (page null), PDF pages as they are (page from 1)."""
    for batch in batches:
        for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "suffix", "content")), strict=True):
            if kind == ".docx":
                rows = [(path, kind, n, None, t) for n, t in enumerate(docx_paragraphs(content))]
            else:
                rows = [(path, kind, n, n + 1, t) for n, t in enumerate(pdf_pages(content))]
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "suffix", "unit_no", "page", "text"])


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, suffix, content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", suffix(F.col("path")).alias("suffix"), "content")


def check_types(found: DataFrame) -> None:
    """Raise for the first file that no reader takes; content is not read."""
    bad = found.where(~F.col("suffix").isin(*SUFFIXES)).select("path", "suffix").first()
    if bad and bad["suffix"] == ".doc":
        raise UnsupportedDocument(f"{bad['path']}: legacy .doc files are not read; convert to .docx first")
    if bad:
        raise UnsupportedDocument(f"{bad['path']}: type {bad['suffix']!r} is none of {', '.join(SUFFIXES)}")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; what is none becomes U+FFFD. A byte order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def read_blocks(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Files as blocks (doc_id, source_base, block_no, page, text); doc_id is the path. With strict=False other files are passed over.

    Missing paths raise when the source is planned. Order within a document is in block_no.
    """
    found = files(spark, path)
    if strict:
        check_types(found)
    plain = found.where(F.col("suffix").isin(".txt", ".md")).select(
        "path", "suffix", F.lit(0).alias("unit_no"), F.lit(None).cast("int").alias("page"), decoded(F.col("content")).alias("text")
    )
    packed = map_arrow(found.where(F.col("suffix").isin(".docx", ".pdf")), _packed, "path string, suffix string, unit_no int, page int, text string")
    # dealt out by document before texts become many rows
    units = by_document(plain.unionByName(packed), "path")
    form = F.col("suffix")
    parts = F.when(form == ".md", markdown_blocks(F.col("text"))).when(form == ".docx", F.array("text")).otherwise(paragraphs(F.col("text")))
    spread = units.select("path", "unit_no", "page", F.posexplode(parts).alias("part_no", "text"))
    return spread.select(
        F.col("path").alias("doc_id"), base_name(F.col("path")).alias("source_base"),
        (F.shiftleft(F.col("unit_no").cast("long"), 32) + F.col("part_no")).alias("block_no"), "page", "text",
    )
