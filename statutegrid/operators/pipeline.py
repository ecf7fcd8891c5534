"""The whole way from blocks to the reviewed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions.language import with_language
from statutegrid.functions.ship import ship
from statutegrid.operators.analyzer import sentences_by, with_tokens
from statutegrid.operators.model import Scorer, with_predictions, with_scores
from statutegrid.operators.review import candidates, reviewed, table
from statutegrid.operators.segments import segment
from statutegrid.operators.sentences import raw_sentences


def analysed(blocks: DataFrame, language: str = "es", load_model: Callable[[], object] | Scorer | None = None, load_analyzer: Callable[[], object] | None = None,
    boundaries: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """blocks (doc_id, source_base, block_no, page, text) as reviewed segments with triggers. language: es, en or auto.

    load_model: makes a model, or a Scorer whose raw scores are decoded in Spark. load_analyzer: makes a parser (`operators/analyzer.py`).
    boundaries: where sentences end, such as `boundaries.learnt_sentences` learns it from a collection; an analyzer's own come first.
    """
    if language not in ("es", "en", "auto"):
        raise ValueError(f"language must be es, en or auto, not {language!r}")
    if load_analyzer is not None:
        ship(blocks.sparkSession)
    raw = (boundaries or raw_sentences) if load_analyzer is None else sentences_by(load_analyzer, language)
    # the language is found while a document's blocks lie together, before they become segments
    found = segment(with_language(blocks) if language == "auto" else blocks.withColumn("language", F.lit(language)), raw)
    if load_analyzer is not None:
        found = with_tokens(found, load_analyzer)
    return judged(found, load_model)


def judged(found: DataFrame, load_model: Callable[[], object] | Scorer | None = None) -> DataFrame:
    """Segments with a model's predictions, if there is one, candidates and review flags; each row by itself, so for streams as well."""
    if isinstance(load_model, Scorer):
        found = with_scores(found, load_model.load, load_model.transitions)
    elif load_model is not None:
        found = with_predictions(found, load_model)
    return reviewed(candidates(found))


def run(
    blocks: DataFrame, language: str = "es", load_model: Callable[[], object] | Scorer | None = None, case: int | None = None, system: str | None = None,
    model_version: str | None = None, load_analyzer: Callable[[], object] | None = None, boundaries: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table, analysed rows): the 21 columns by document, and the rows that the sidecar is made from.

    Both are plans: each action on either goes through model and analyzer again. To write both, see sources/sinks.py: write_analysis.
    """
    rows = analysed(blocks, language, load_model, load_analyzer, boundaries)
    return table(rows, system, case, model_version), rows


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
