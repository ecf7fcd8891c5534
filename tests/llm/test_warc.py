import zlib

import pytest

from statutegrid.llm import warc
from tests.llm.conftest import LONG


def test_one_member_a_record_and_chunks_of_any_size():
    payloads = [b"", b"x", "é<p>".encode() * 1000, bytes(range(256)) * 300]
    data = b"".join(warc.write_record(i, f"http://a/{i}\r\nWARC-Type: evil", p, None, False) for i, p in enumerate(payloads))
    data += warc.EMPTY_MEMBER
    for size in (1, 7, 1000, len(data)):
        got = list(warc.read_records(data[i : i + size] for i in range(0, len(data), size)))
        assert [r.http[1] for r in got] == payloads
        assert all(r.headers["warc-type"] == "response" for r in got)
    assert list(warc.read_records([])) == []


def test_broken_archives_are_refused():
    good = warc.write_record(1, "u", b"payload", None, False)
    with pytest.raises(warc.WarcError):
        list(warc.read_records([good[:-5]]))
    with pytest.raises(warc.WarcError):
        list(warc.read_records([good, b"no gzip"]))
    plain = zlib.decompress(good, 31)

    def pack(data):
        z = zlib.compressobj(wbits=31)
        return z.compress(data) + z.flush()

    assert len(list(warc.read_records([pack(plain)]))) == 1
    for broken in (plain.replace(b"payload", b"payl0ad"), plain[:-4], plain + b"x", plain.replace(b"Content-Length", b"Content-Width"), b"x" + plain):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([pack(broken)]))


def test_round_trip_with_odd_pages(spark, tmp_path):
    rows = [
        (5, "u5", "same", 1), (3, "u3", "same", 1), (3, "u3", "same", 1), (9, None, "same", 1), (None, "n", "same", 1), (1, "e", None, 1), (2, "e", "", 1), (4, "é", "ü\0\r\n\r\n", 1), (6, "long", LONG, 1), (None, "alone", "nobody", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(3)
    warc.write_archives(pages, f"{tmp_path}/w", records=2)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        first = min((j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None), default=None)
        later = first is not None and i != first
        want.append((i, len(p), warc.digest(p), "revisit" if later else "response", first if later else None))
    assert got == sorted(want, key=str)
    texts = {r["page_id"]: r["t"] for r in warc.read_archives(spark, f"{tmp_path}/w").where("record_type = 'response'").select("page_id", warc.payload_text(__import__("pyspark").sql.functions.col("payload")).alias("t")).collect()}
    assert texts[6] == LONG and texts[4] == "ü\0\r\n\r\n"
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    warc.write_archives(pages.where("page_id = 6").selectExpr("page_id", "url", "repeat(html, 100) AS html"), f"{tmp_path}/big")  # above 16 MB: ends in an empty member
    assert warc.read_archives(spark, f"{tmp_path}/big").first()["payload_bytes"] == 100 * len(LONG)


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w", min_bytes=4)
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, f"{tmp_path}/w").collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    noise = "hex(aes_encrypt(repeat(cast(page_id AS string), 4000), '0123456789abcdef', 'ECB'))"
    pages = spark.range(60).selectExpr("id AS page_id", "'u' AS url").selectExpr("*", f"{noise} AS html").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", size=5_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 3 and max(sizes) <= 5_000 + 60
    assert warc.read_archives(spark, f"{tmp_path}/w").select("page_id").distinct().count() == 60
