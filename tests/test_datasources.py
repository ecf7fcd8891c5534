"""Documents by a Python data source, workbooks for collections by another."""

import json
import os
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

import statutegrid
from statutegrid.operators.review import COLUMNS, technical
from statutegrid.operators.summary import summary
from statutegrid.sources import datasources as D
from statutegrid.sources.sinks import Workbook, sidecar
from tests.test_files import MD, cells, docx


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    for n in range(5):
        (source / f"{n}. R.md").write_text(MD * (n + 1), encoding="utf-8")
    (source / "deep" / "9. T.TXT").write_bytes("uno\ndos\n\ntr\xe9s".encode("latin-1"))
    docx(source / "deep" / "8. W.docx", [["Art. 1. ", "Los socios"], ["votan"]])
    (source / "broken.docx").write_bytes(b"no archive")
    (source / "old.doc").write_bytes(b"x")
    (source / "notes.rtf").write_bytes(b"x")
    (source / "_SUCCESS").touch()
    return source


def test_files_that_cannot_be_read_are_rows_with_their_reason(spark, folder):
    blocks, unreadable = statutegrid.read_reported(spark, str(folder))
    reasons = {r["source_base"]: r["reason"] for r in unreadable.collect()}
    assert set(reasons) == {"broken.docx", "old.doc", "notes.rtf"}
    assert reasons["broken.docx"].startswith("BadZipFile") and "legacy" in reasons["old.doc"] and "none of" in reasons["notes.rtf"]
    for n in ("broken.docx", "old.doc", "notes.rtf"):
        os.remove(folder / n)
    key = lambda df: sorted((r["source_base"], r["block_no"], r["page"], r["text"]) for r in df.collect())
    old = statutegrid.read_blocks(spark, [str(folder), str(folder / "deep")])
    assert key(statutegrid.read_reported(spark, str(folder))[0]) == key(old)
    assert key(statutegrid.read_reported(spark, f"file://{folder}/deep")[0]) == [x for x in key(old) if x[0] in ("9. T.TXT", "8. W.docx")]
    with pytest.raises(Exception, match="no such file or folder"):
        statutegrid.read_reported(spark, str(folder / "none"))[0].count()


class Counting(D.DocumentReader):
    """Leaves a mark for each file that it opens."""

    def opened(self, path):
        Path(self.marks, Path(path).name).touch()
        return super().opened(path)


def test_pushed_filters_open_no_other_file(spark, folder, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    reader = Counting({"path": str(folder)})
    reader.marks = str(marks)
    left = list(reader.pushFilters([EqualTo(("suffix",), ".md"), GreaterThan(("length",), 200), StringContains(("text",), "x")]))
    assert [type(f) for f in left] == [StringContains]
    for part in reader.partitions():
        list(reader.read(part))
    assert {p.name for p in marks.iterdir()} == {f"{n}. R.md" for n in range(5) if len((MD * (n + 1)).encode()) > 200}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    D.register(spark)
    source = spark.read.format("statutegrid-documents").load(str(folder))
    some = source.where(F.col("suffix").isin(".txt", ".docx") & F.col("path").contains("deep"))
    assert sorted({r["path"].rsplit("/", 1)[1] for r in some.collect()}) == ["8. W.docx", "9. T.TXT"]
    assert "Filter " not in plan(source.where("suffix = '.md'"))
    assert source.where("suffix = '.pdf'").count() == 0


def test_partitions_are_planned_by_bytes(folder):
    sizes = sorted((str(p), p.stat().st_size) for p in folder.rglob("*") if p.is_file() and p.name[0] not in "._")
    for most in (1, 300, 10**9):
        parts = D.DocumentReader({"path": str(folder), "partitionBytes": str(most)}).partitions()
        assert sorted(f for p in parts for f in p.files) == sizes
        assert all(len(p.files) == 1 or sum(n for _, n in p.files) <= most for p in parts)


def opened(path):
    with zipfile.ZipFile(path) as z:
        return [cells(z.read(f"xl/worksheets/sheet{i}.xml").decode()) for i in (1, 2, 3)]


def test_a_workbook_a_document_built_on_executors(spark, folder, tmp_path):
    rows = statutegrid.analysed(statutegrid.read_reported(spark, str(folder))[0], "es").persist()
    statutegrid.write_workbooks(rows, f"{tmp_path}/out")
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    books = [f for f in files if f.endswith(".xlsx")]
    assert len(books) == 7 and len([f for f in files if f.endswith("_technical.json")]) == 7 and not [f for f in files if f.startswith(".")]
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {".json": 7, ".xlsx": 7}
    table = statutegrid.operators.review.table(rows)
    for doc in {r["doc_id"] for r in table.select("doc_id").distinct().collect()}:
        one = table.where(F.col("doc_id") == doc)
        stem = Path(doc).stem
        book = next(b for b in books if b.startswith(stem + "-"))
        got, same = opened(tmp_path / "out" / book), opened(statutegrid.write_workbook(one, tmp_path / "one.xlsx"))
        assert got == same
        shown = [(got[2].get(f"A{n}", (None,))[0], got[2][f"B{n}"][0], got[2].get(f"C{n}", (None,))[0]) for n in range(2, 2 + len([k for k in got[2] if k[0] == "A"]) - 1)]
        want = [tuple(r) for r in summary(one).orderBy("section_no", "rank").select("section", "key_text", "value").collect()]
        assert shown == want
        side = json.loads((tmp_path / "out" / book.replace(".xlsx", "_technical.json")).read_text())
        assert side == json.loads(json.dumps(sidecar(technical(rows.where(F.col("doc_id") == doc)).orderBy("segment_id").collect())))
    statutegrid.write_workbooks(rows.where(F.col("source_base") == "0. R.md"), f"{tmp_path}/out", with_technical=False, mode="overwrite")
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 1 and not list((tmp_path / "out").glob("*.json"))
    rows.unpersist()


def batch(rows):
    names = ["doc_id", *COLUMNS]
    filled = [{c: r.get(c, False if c in ("needs_review", "is_substantive") else "x") for c in names} for r in rows]
    return pa.RecordBatch.from_pylist(filled)


def test_a_failed_task_leaves_no_file_and_a_failed_job_none(spark, tmp_path):
    writer = D.WorkbookWriter({"path": str(tmp_path / "out")}, False, ["doc_id", *COLUMNS])

    def broken():
        yield batch([{"doc_id": "a", "source_base": "a.md"}, {"doc_id": "b", "source_base": "b.md"}])
        raise OSError("the executor's disk is gone")

    with pytest.raises(OSError):
        writer.write(broken())
    assert list((tmp_path / "out").glob("*.xlsx")) == []
    one, two = ([batch([{"doc_id": "a", "source_base": "a.md"}])] for _ in range(2))
    first, again = writer.write(iter(one)), writer.write(iter(two))  # an attempt that ran twice
    assert list((tmp_path / "out").glob("*.xlsx")) == [] and first.files[0][1] == again.files[0][1]
    writer.commit([again, None])
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 1 and not [p for p in (tmp_path / "out").iterdir() if p.name[0] == "."]
    late = writer.write(iter([batch([{"doc_id": "z", "source_base": "z.md"}])]))
    writer.abort([late, None])
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir()) == ["", ".xlsx"]
    with pytest.raises(ValueError, match="not together"):
        writer.write(iter([batch([{"doc_id": d} for d in "aba"])]))
    with pytest.raises(ValueError, match="no column"):
        D.WorkbookWriter({"path": "x"}, False, ["doc_id"])
    bad = spark.range(3).select(F.lit("d").alias("doc_id"), *[F.lit("x").alias(c) for c in COLUMNS]).repartition(3)
    bad = bad.withColumn("source_base", F.when(F.spark_partition_id() == 1, F.raise_error(F.lit("lost"))).otherwise("d.md"))
    with pytest.raises(Exception, match="lost"):
        D.register(spark)
        bad.write.format("statutegrid-workbooks").mode("append").save(f"{tmp_path}/job")
    assert not list((tmp_path / "job").glob("*.xlsx")) and not (tmp_path / "job" / "_SUCCESS").exists()


def test_an_empty_workbook_is_whole(tmp_path):
    with (tmp_path / "e.xlsx").open("wb") as f:
        Workbook().finish(f)
    assert cells(zipfile.ZipFile(tmp_path / "e.xlsx").read("xl/worksheets/sheet3.xml"))["C2"][0] == "0"
