import json
import subprocess
import sys
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pytest

import statutegrid
from statutegrid import cli
from statutegrid.operators.review import COLUMNS, technical
from statutegrid.sources import readers, sinks
from statutegrid.streaming import files as stream

MD = "# Capítulo 1. De los socios\nLos socios deberán aprobar la cuota anual. Son obligaciones de los socios:\n- a) pagar\n- b) asistir a todo\n"
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def docx(path, paragraphs):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{r}</w:t></w:r>' for r in p)}</w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}{table}</w:body></w:document>')


def test_readers(spark, tmp_path):
    (tmp_path / "7. Reglamento.MD").write_text(MD, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfuno\ndos\n\n\ntr\xffes\n\n \n")
    docx(tmp_path / "c.docx", [["Art. 1. ", "Los socios"], ["  "], ["votan"]])
    got = {}
    for r in statutegrid.read_blocks(spark, str(tmp_path)).orderBy("block_no").collect():
        got.setdefault(r["source_base"], []).append((r["page"], r["text"]))
    assert got["7. Reglamento.MD"][0] == (None, "Capítulo 1. De los socios")
    assert got["b.txt"] == [(None, "﻿uno dos"), (None, "tr�es")]
    assert got["c.docx"] == [(None, "Art. 1. Los socios"), (None, "votan")]
    for name, words in (("d.doc", "legacy"), ("e.rtf", "none of")):
        other = tmp_path / "bad" / name
        other.parent.mkdir(exist_ok=True)
        other.write_text("x")
        with pytest.raises(readers.UnsupportedDocument, match=words):
            statutegrid.read_blocks(spark, str(other))
        assert readers.read_blocks(spark, str(other), strict=False).count() == 0
    with pytest.raises(Exception, match="(?i)not.found|not exist"):
        statutegrid.read_blocks(spark, str(tmp_path / "none.md")).count()


def cells(sheet):
    out = {}
    for c in ElementTree.fromstring(sheet).iterfind(".//m:c", NS):
        value = c.find("m:is/m:t", NS) if c.get("t") == "inlineStr" else c.find("m:v", NS)
        out[c.get("r")] = (None if value is None else value.text, c.get("s"))
    return out


def test_workbook_and_sidecar(spark, tmp_path):
    source = tmp_path / "12. Reglas.md"
    source.write_text(MD, encoding="utf-8")
    out = cli.run_file(spark, str(source), language="es")
    assert out == tmp_path / "12. Reglas_paso1.xlsx"
    with zipfile.ZipFile(out) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", NS)]
        segments, schema, summary = (z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3))
    assert names == ["segments", "schema", "summary"]
    got = cells(segments)
    assert [got[f"{sinks._column(i)}1"] for i in range(1, 22)] == [(c, "1") for c in COLUMNS]
    assert got["A2"][0] == "12" and got["C2"][0] == "seg_0001" and got["L2"][0] == "Capítulo 1. De los socios"
    assert '<autoFilter ref="A1:U' in segments and 'topLeftCell="F2"' in segments
    review = {k[1:]: v[0] for k, v in got.items() if k[0] == "R" and k != "R1"}
    assert "1" in review.values() and all((got[f"C{n}"][1] == "3") == (v == "1") and got[f"L{n}"][1] == ("4" if v == "1" else "2") for n, v in review.items())
    assert len(cells(schema)) == 44 and ("n_segments", None) in {(v[0], None) for v in cells(summary).values()}
    side = json.loads((tmp_path / "12. Reglas_paso1_technical.json").read_text(encoding="utf-8"))
    assert sorted(side) == sorted(v[0] for k, v in got.items() if k[0] == "C" and k != "C1")
    assert any(s["surface"] == "deberán" and s["end"] is None for v in side.values() for s in v["spans"])


def test_tables(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}. R.md").write_text(MD, encoding="utf-8")
    table, rows = statutegrid.run(statutegrid.read_blocks(spark, f"{tmp_path}/*.md"), language="auto")
    statutegrid.write_tables(table, technical(rows), f"{tmp_path}/out")
    back = {n: spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("segments", "summary", "schema", "technical")}
    assert back["segments"].count() == back["technical"].count() > 0 and back["segments"].columns == ["doc_id", *COLUMNS]
    assert {r["case_id"] for r in back["segments"].collect()} == {0, 1, 2} and back["schema"].count() == 21
    assert not any(r["segment_text"] == "" for r in back["segments"].collect())
    with pytest.raises(ValueError, match="one document"):
        statutegrid.write_workbook(table, tmp_path / "x.xlsx")
    with pytest.raises(ValueError):
        statutegrid.run(statutegrid.read_blocks(spark, f"{tmp_path}/0. R.md"), language="fr")


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(4):
        (source / f"{n}. R.md").write_text(MD * (n + 1), encoding="utf-8")
    stream.start(stream.file_stream(spark, str(source), files_per_batch=2), f"{tmp_path}/out", f"{tmp_path}/cp", language="es").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want, _ = statutegrid.run(statutegrid.read_blocks(spark, str(source)), language="es")
    key = lambda df: sorted((r["source_base"], *map(str, r[1:])) for r in df.collect())
    assert key(got) == key(want)
    assert len(list(Path(f"{tmp_path}/out").glob("batch=*"))) == 2


def test_command_line(tmp_path):
    (tmp_path / "1. R.md").write_text(MD, encoding="utf-8")
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-m", "statutegrid.cli", str(tmp_path / "1. R.md"), "-o", str(tmp_path / "o" / "x.xlsx"), "--no-technical"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.strip().endswith("x.xlsx") and [p.name for p in (tmp_path / "o").iterdir()] == ["x.xlsx"]
    args = cli.parser().parse_args(["a.md"])
    assert (args.language, args.output, args.no_technical) == ("auto", None, False)
    with pytest.raises(ValueError):
        cli.model_loader("json:nothing")
    assert cli.model_loader("collections:OrderedDict")() == {}
