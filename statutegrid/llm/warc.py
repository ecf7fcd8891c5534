"""Operator 5, WARC: one gzip member a record, and a sequential reader.

Writing: Spark's text writer puts the members on any file system that Spark can write to. It ends each row with a
separator, here the byte 00; as a member ends with its length in four bytes, little-endian, its last byte is 00 below 16 MB
and is left to the writer. A larger record is followed by an empty member, whose last byte is 00 as well.

Reading: `read_records` takes any iterable of byte chunks, keeps one zlib decompressor running, starts another one
where a member ends, frames blocks by Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import bounded, cut, scratch_path, table

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
LEVEL = 3
CHUNK = 1 << 16
#: An archive ends behind so many records or so many bytes; one larger record has an archive of its own.
RECORDS_PER_ARCHIVE, BYTES_PER_ARCHIVE = 1000, 64 << 20
MIN_BYTES = 0
EMPTY_MEMBER = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()


class WarcError(ValueError):
    """A record that breaks the format or its own digests."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_digest}>"


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def write_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone and names the record it repeats."""
    own = digest(payload)
    head = HTTP.format(len(payload)).encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _id(page_id, own),
        "WARC-Date": DATE,
        "WARC-Target-URI": _line(url),
        "WARC-Payload-Digest": f"sha1:{own}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(first, own)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(CRLF + CRLF) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, mark, body = self.block.partition(CRLF + CRLF)
        if not mark:
            raise WarcError("no end of the HTTP head")
        return _fields(head.split(CRLF)[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _record(data: bytes) -> Record:
    head, mark, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not mark or not lines[0].startswith(b"WARC/"):
        raise WarcError("a member does not start with a record")
    headers = _fields(lines[1:])
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no usable Content-Length") from None
    if n < 0 or len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
        raise WarcError("the block is not as long as Content-Length says")
    record = Record(headers, rest[:n])
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(record.block)}":
        raise WarcError("block digest differs")
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")) and said != f"sha1:{digest(record.http[1])}":
        raise WarcError("payload digest differs")
    return record


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records in order. Empty members and nothing at all are no records; a cut or foreign member raises WarcError."""
    unpacker, parts, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            try:
                parts.append(unpacker.decompress(chunk))
            except zlib.error as e:
                raise WarcError(str(e)) from None
            fed = True
            chunk = unpacker.unused_data
            if unpacker.eof:
                if data := b"".join(parts):
                    yield _record(data)
                unpacker, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise WarcError("the last member is cut")


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with _first, the response's page_id, and _revisit.

    Digests and the smallest ids by digest are found without the texts. Rows of the same id and payload are one page: all of them
    are responses. Rows without an id revisit the page with one, if any. Null html is empty; other columns are ignored.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha1(payload.cast("binary")).alias("_sha"), F.octet_length(payload).alias("_n"))
    keyed = keyed.where(F.col("_n") >= min_bytes)
    first = keyed.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows"))
    later = first.where("_rows > 1 and _first is not null").select("_sha", "_first")
    repeats = keyed.join(later, "_sha").where("page_id is null or page_id <> _first").select(F.col("page_id").alias("_id"), "_sha", "_first").distinct()
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("_own"))
    return rows.join(bounded(cut(repeats, "warc-repeats")), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left").select(
        "page_id", "url", "html", "_first", F.col("_first").isNotNull().alias("_revisit")
    )


def _members(batches: Iterator[pa.RecordBatch], records: int, size: int) -> Iterator[pa.RecordBatch]:
    """Members in order, with the number of the task's archive that each belongs to."""
    archive = held = used = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            out, at = [], []
            for r in batch.slice(i, 64).to_pylist():
                member = write_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["_first"], r["_revisit"])
                member = member[:-1] if member[-1] == 0 else member + EMPTY_MEMBER[:-1]
                if held and (held == records or used + len(member) > size):
                    archive, held, used = archive + 1, 0, 0
                held, used = held + 1, used + len(member)
                out.append(member)
                at.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(at, pa.int32())], ["member", "archive"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, records: int = RECORDS_PER_ARCHIVE, size: int = BYTES_PER_ARCHIVE) -> None:
    """WARC files of at most so many records and bytes under path, a folder a number; Spark's committer makes lost tasks safe."""
    rows = map_arrow(plan_revisits(pages, min_bytes), lambda it: _members(it, records, size), "member binary, archive int")
    rows = rows.select(F.col("member").cast("string"), "archive")
    rows.write.option("lineSep", "\x00").partitionBy("archive").text(path)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(mark: str | None) -> int | None:
        part = (mark or "<urn:page:none:>").split(":")[2]
        return None if part == "none" else int(part)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            view, rows = memoryview(content.as_buffer()), []
            for r in read_records(view[i : i + CHUNK] for i in range(0, len(view), CHUNK)):
                h = r.headers
                http, body = r.http
                kind = h["warc-type"]
                rows.append((
                    number(h.get("warc-record-id")), h.get("warc-target-uri"), None if kind == "revisit" else body, int(http["content-length"]),
                    h["warc-payload-digest"].removeprefix("sha1:"), kind, number(h.get("warc-refers-to")) if kind == "revisit" else None,
                ))
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all archives under path: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return map_arrow(
        files,
        _pages,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def payload_text(payload: Column) -> Column:
    return F.decode(payload, "UTF-8")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32: every five hex digits are four characters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

QUERIES = {"op5_warc_round_trip": op5_warc_round_trip}
ORACLES = {"op5_warc_round_trip": SQL}
