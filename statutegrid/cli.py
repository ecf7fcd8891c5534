"""Command line: one document to a workbook, or a folder of documents to tables."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from statutegrid.operators.model import Scorer
from statutegrid.operators.pipeline import analysed
from statutegrid.operators.review import table, technical
from statutegrid.sources.datasources import read_reported, write_workbooks
from statutegrid.sources.models import scorer
from statutegrid.sources.readers import read_blocks
from statutegrid.sources.sinks import write_analysis, write_workbook

MODEL_VARIABLE = "STATUTEGRID_MODEL"


def _named(reference: str) -> Callable:
    """What module:function names. Checked here, called in the workers."""
    module, _, name = reference.partition(":")
    found = getattr(importlib.import_module(module), name, None) if name else None
    if not callable(found):
        raise ValueError(f"{reference!r} is not module:function")
    return found


def model_loader(reference: str | None, runner: str | None = None) -> Callable[[], object] | Scorer | None:
    """What makes the model; None without a reference. With a runner, the reference is a folder of weights or a library's identifier."""
    if not reference:
        return None
    if runner:
        return scorer(reference, _named(runner))
    _named(reference)
    return lambda: _named(reference)()


def run_file(
    spark: SparkSession, input_path: str, output_path: str | None = None, load_model: Callable[[], object] | Scorer | None = None, language: str = "auto",
    write_technical: bool = True, load_analyzer: Callable[[], object] | None = None,
) -> Path:
    """One document; the workbook goes beside it as <stem>_paso1.xlsx unless told otherwise. It is analysed once."""
    source = Path(input_path)
    if not source.exists():
        raise FileNotFoundError(f"no such file: {source}")
    out = Path(output_path) if output_path else source.with_name(f"{source.stem}_paso1.xlsx")
    rows = analysed(read_blocks(spark, str(source)), language, load_model, load_analyzer).persist()
    try:
        return write_workbook(table(rows), out, technical(rows) if write_technical else None)
    finally:
        rows.unpersist()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="statutegrid", description="Regulatory documents to reviewable tables of segments.")
    p.add_argument("input", help="a document (.pdf, .docx, .txt, .md), or a folder of them")
    p.add_argument("-o", "--output", help="workbook for a document; folder of tables for a folder")
    p.add_argument("-m", "--model", default=os.environ.get(MODEL_VARIABLE), help=f"module:function that makes the model (or {MODEL_VARIABLE}); without, verbs are found by the lexicon")
    p.add_argument("--runner", help="module:function(name, settings) that loads what --model names, a folder of weights or an identifier, and gives raw scores")
    p.add_argument("--analyzer", help="module:function that makes a parser; without, rules find sentences and verbs")
    p.add_argument("-l", "--language", choices=("auto", "es", "en"), default="auto")
    p.add_argument("--workbooks", action="store_true", help="for a folder: a workbook a document, built on the executors, and a list of files that cannot be read; not tables")
    p.add_argument("--no-technical", action="store_true", help="write no technical sidecar")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("statutegrid").getOrCreate()
    load = model_loader(args.model, args.runner)
    analyzer = model_loader(args.analyzer)
    if Path(args.input).is_dir() and args.workbooks:
        out = args.output or f"{args.input.rstrip('/')}_workbooks"
        blocks, unreadable = read_reported(spark, args.input)
        write_workbooks(analysed(blocks, args.language, load, analyzer), out, not args.no_technical)
        unreadable.write.mode("overwrite").json(f"{out}/unreadable")
    elif Path(args.input).is_dir():
        out = args.output or f"{args.input.rstrip('/')}_tables"
        write_analysis(analysed(read_blocks(spark, args.input), args.language, load, analyzer), out, not args.no_technical)
    else:
        out = run_file(spark, args.input, args.output, load, args.language, not args.no_technical, analyzer)
    print(f"Wrote {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
