"""Results to files: partitioned tables for any number of documents, a workbook and a JSON sidecar for one."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from statutegrid.operators.review import COLUMNS, technical
from statutegrid.operators.review import table as table_of
from statutegrid.operators.summary import SECTIONS, summary

#: What each column means, for the schema sheet, in this project's words.
DESCRIPTIONS = {
    "case_id": "Number of the case, from the file name or the caller.",
    "system": "Resource system that the rules are about, where known.",
    "segment_id": "Identifier of the segment, stable within its document.",
    "parent_segment_id": "Segment that this one depends on; for items the list's header.",
    "segment_order": "Place in reading order.",
    "title": "Title in force.",
    "chapter": "Chapter in force.",
    "article": "Article or section in force.",
    "segment_type": "body_sentence, list_header, list_item, heading, preamble, signature, annex or metadata.",
    "is_list_item": "Whether the segment is an item of a list.",
    "is_substantive": "Whether the segment is a candidate for coding rather than documentary context.",
    "segment_text": "The segment's text, as it stands.",
    "aim_n_suggested": "Suggested number of aims; an aid, no final count.",
    "aim_text_candidate": "Text of each candidate, joined with ' | '.",
    "aim_trigger_candidate": "Verb that seems to set off each candidate, joined with ' | '.",
    "aim_candidate_confidence": "The model's confidence, 0 to 1.",
    "has_own_aim_candidate": "Whether the segment seems to carry an aim of its own.",
    "needs_review": "Whether somebody should look at the segment.",
    "review_reason": "Why, joined with semicolons.",
    "model_version": "Model that the suggestions come from.",
    "source_base": "File that the document was read from.",
}
#: Widths of the segments sheet's columns, others 9.
WIDTHS = {
    "segment_id": 11, "parent_segment_id": 11, "segment_type": 14, "title": 16, "chapter": 16, "article": 9, "segment_text": 80,
    "aim_text_candidate": 60, "aim_trigger_candidate": 18, "review_reason": 24, "model_version": 18, "source_base": 22,
}
REVIEW_FILL = "FFF3CD"


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, DESCRIPTIONS[c]) for n, c in enumerate(COLUMNS, 1)], "column_no int, column string, description string")


def write_tables(table: DataFrame, technical: DataFrame | None, path: str, mode: str = "errorifexists") -> None:
    """segments, schema, summary and, if given, technical as Parquet folders under path. For collections of documents.

    The summary is made from the segments as written. table and technical are worked out one after the other: where both come from one
    analysis, write_analysis goes through it once.
    """
    spark = table.sparkSession
    table.write.mode(mode).parquet(f"{path}/segments")
    summary(spark.read.schema(table.schema).parquet(f"{path}/segments")).write.mode(mode).parquet(f"{path}/summary")
    schema_table(spark).write.mode(mode).parquet(f"{path}/schema")
    if technical is not None:
        technical.write.mode(mode).parquet(f"{path}/technical")


def write_analysis(
    rows: DataFrame, path: str, with_technical: bool = True, mode: str = "errorifexists", system: str | None = None, case: int | None = None, model_version: str | None = None
) -> None:
    """The tables of write_tables from analysed rows (`operators/pipeline.py: analysed`), each of which goes through model and analyzer once.

    What the analysis found is written once, to analysed under path; the tables are made from that, which then goes.
    """
    spark, stage = rows.sparkSession, f"{path}/analysed"
    whole = table_of(rows, system, case, model_version, "triggers", "confidence")
    whole.write.mode(mode).parquet(stage)
    read = spark.read.schema(whole.schema).parquet(stage)
    write_tables(read.select("doc_id", *COLUMNS), technical(read) if with_technical else None, path, mode)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sidecar(technical: list) -> dict:
    return {r["segment_id"]: {"spans": [s.asDict() for s in r["spans"]], "confidence": r["confidence"]} for r in technical}


def _column(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, column: int, value: object, style: int) -> str:
    at = f'r="{_column(column)}{row}"' + (f' s="{style}"' if style else "")
    if value is None:
        return f"<c {at}/>" if style else ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {at}><v>{value}</v></c>"
    text = "".join(c if c in "\t\n" or ord(c) >= 32 else " " for c in str(value))
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _row(n: int, values: tuple, style: Callable[[int], int]) -> str:
    return f'<row r="{n}">' + "".join(_cell(n, i, v, style(i)) for i, v in enumerate(values, 1)) + "</row>"


def _head(header: list[str], widths: list[float], freeze: str = "") -> str:
    """A sheet up to its first row."""
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    pane = ""
    if freeze:
        x, y = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(freeze.rstrip("0123456789")))) - 1, int("".join(c for c in freeze if c.isdigit())) - 1
        pane = f'<pane xSplit="{x}" ySplit="{y}" topLeftCell="{freeze}" activePane="bottomRight" state="frozen"/>'
    return (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f'<sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews><cols>{cols}</cols><sheetData>{_row(1, tuple(header), lambda i: 1)}'
    )


def _foot(columns: int, rows: int, filter_: bool = False) -> str:
    return "</sheetData>" + (f'<autoFilter ref="A1:{_column(columns)}{rows + 1}"/>' if filter_ else "") + "</worksheet>"


_STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
    f'<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF{REVIEW_FILL}"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>'
    '<xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf><xf fillId="2" applyFill="1"/>'
    '<xf fillId="2" applyFill="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>'
)


class Workbook:
    """One document's workbook, row by row: rows go into the archive as they come, in the order of their segments; what the summary counts is kept beside them."""

    NAMES = ("segments", "schema", "summary")

    def __init__(self) -> None:
        self._buffer = io.BytesIO()
        self._zip = zipfile.ZipFile(self._buffer, "w", zipfile.ZIP_DEFLATED)
        self._rows = 0
        self._facts: list[tuple] = []
        self._counts: dict[int, Counter] = {n: Counter() for n in range(1, len(SECTIONS) + 1)}
        self._sheet = self._zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._put(_head(list(COLUMNS), [WIDTHS.get(c, 9) for c in COLUMNS], f"{_column(COLUMNS.index('title') + 1)}2"))

    def _put(self, text: str) -> None:
        self._sheet.write(text.encode())

    def add(self, row: tuple) -> None:
        """A row of the 21 columns."""
        value = dict(zip(COLUMNS, row, strict=True))
        self._rows += 1
        review, wrap = value["needs_review"], ("segment_text", "aim_text_candidate")
        self._put(_row(self._rows + 1, row, lambda i: (3 if review else 0) + ((1 if review else 2) if COLUMNS[i - 1] in wrap else 0)))
        if self._rows == 1:
            self._facts = [("document", c, None if value[c] is None else str(value[c])) for c in ("case_id", "source_base", "model_version")]
        for n, section in enumerate(SECTIONS, 1):
            if section == "review_reason":
                self._counts[n].update(x for x in (value[section] or "").split(";") if x)
            elif section != "aim_n_suggested" or value["is_substantive"]:
                self._counts[n]["nan" if value[section] is None else str(value[section])] += 1

    def summary(self) -> list[tuple]:
        """(section, key, value) in the order of `operators/summary.py: summary`."""
        out = [*self._facts, ("document", "n_segments", str(self._rows))]
        for n, section in enumerate(SECTIONS, 1):
            order = sorted(self._counts[n].items(), key=lambda x: (0 if section == "aim_n_suggested" else -x[1], x[0]))
            out += [(section, k, str(c)) for k, c in order]
        return out

    def finish(self, out: BinaryIO) -> None:
        """Write the whole archive."""
        self._put(_foot(len(COLUMNS), self._rows, True))
        self._sheet.close()
        others = ((["column", "description"], [(c, DESCRIPTIONS[c]) for c in COLUMNS], [26, 100]), (["section", "key", "value"], self.summary(), [18, 34, 40]))
        for i, (header, rows, widths) in enumerate(others, 2):
            lines = "".join(_row(n, r, lambda _: 0) for n, r in enumerate(rows, 2))
            self._zip.writestr(f"xl/worksheets/sheet{i}.xml", _head(header, widths) + lines + _foot(len(header), len(rows)))
        main, rel, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z = self._zip
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, 4)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(self.NAMES, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, 4)) + f'<Relationship Id="rId4" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.close()
        out.write(self._buffer.getvalue())


def write_workbook(table: DataFrame, out_path: str | Path, technical: DataFrame | None = None) -> Path:
    """One document's table as a workbook of three sheets, and <stem>_technical.json beside it if technical is given.

    Its rows come to the driver, one partition after another. For collections see `datasources.write_workbooks`, which builds workbooks on the executors, and write_tables.
    """
    out = Path(out_path)
    out.parent.mkdir(parents=True, exist_ok=True)
    if table.select("doc_id").distinct().limit(2).count() > 1:
        raise ValueError("a workbook holds one document; use write_workbooks or write_tables for collections")
    book = Workbook()
    for row in table.select(*COLUMNS).orderBy("segment_order").toLocalIterator():
        book.add(tuple(row))
    with out.open("wb") as f:
        book.finish(f)
    if technical is not None:
        found = sidecar(technical.orderBy("segment_id").collect())
        out.with_name(f"{out.stem}_technical.json").write_text(json.dumps(found, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    return out
