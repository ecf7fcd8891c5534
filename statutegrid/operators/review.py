"""Candidates, review flags and the 21-column table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.functions.text import let, starts_lower
from statutegrid.operators.analyzer import aims_of_tokens
from statutegrid.operators.verbs import extract_aims, first_aim, first_verb

COLUMNS = (
    "case_id", "system", "segment_id", "parent_segment_id", "segment_order", "title", "chapter", "article", "segment_type", "is_list_item",
    "is_substantive", "segment_text", "aim_n_suggested", "aim_text_candidate", "aim_trigger_candidate", "aim_candidate_confidence",
    "has_own_aim_candidate", "needs_review", "review_reason", "model_version", "source_base",
)
HEURISTIC, MODEL = "heuristic_extractor", "model-1.0"
TRIGGER = "array<struct<surface:string,lemma:string,start:int,end:int,span_text:string>>"


def case_id(name: Column) -> Column:
    """Leading digits of a file name."""
    return F.regexp_extract(name, r"(?U)^\s*(\d+)", 1).try_cast("int")


def _trigger(surface: Column, lemma: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(surface.alias("surface"), lemma.alias("lemma"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("span_text"))


def heuristic_triggers(hits: Column, text: Column) -> Column:
    """Every verb hit is a candidate whose text is the whole segment."""
    return F.transform(hits, lambda a: _trigger(a["verb"], a["lemma"], a["position"], F.lit(None), text))


def span_trigger(span: Column, hits: Column, language: Column) -> Column:
    """First verb of the span's text, else the segment's first verb that begins inside it, else any verb of the span's, in the lexicon or not."""
    def chosen(x: Column) -> Column:
        own, inside = x["own"], x["inside"]
        last = F.when(own.isNull() & inside.isNull(), first_verb(span["text"], language))
        return _trigger(F.coalesce(own["verb"], inside["verb"], last["verb"]), F.coalesce(own["lemma"], inside["lemma"], last["lemma"]), span["start"], span["end"], span["text"])

    inside = F.get(F.filter(hits, lambda a: (a["position"] >= span["start"]) & (a["position"] < span["end"])), F.lit(0))
    return let(F.struct(first_aim(span["text"], language).alias("own"), inside.alias("inside")), chosen)


def candidates(segments: DataFrame) -> DataFrame:
    """segments (segment_text, language, perhaps prediction and tokens) with triggers and the five candidate columns.

    A segment's verbs are found once: by an analyzer's tokens where it gave them, else by `extract_aims`.
    """
    text, language = F.col("segment_text"), F.col("language")
    hits = aims_of_tokens(F.col("tokens"), language) if "tokens" in segments.columns else extract_aims(text, language)
    if "prediction" in segments.columns:
        found = let(hits, lambda all_: F.transform("prediction.spans", lambda s: span_trigger(s, all_, language)))
        count, confidence = F.col("prediction.count"), F.col("prediction.confidence")
    else:
        found = let(hits, lambda all_: heuristic_triggers(all_, text))
        count, confidence = F.size("triggers"), F.lit(None).cast("double")
    rows = segments.withColumn("triggers", found)
    return rows.select(
        "*", count.alias("aim_n_suggested"), F.array_join(F.transform("triggers", lambda t: t["span_text"]), " | ").alias("aim_text_candidate"),
        F.array_join(F.filter(F.transform("triggers", lambda t: t["surface"]), lambda s: s != ""), " | ").alias("aim_trigger_candidate"),
        F.bround(confidence, 4).alias("aim_candidate_confidence"), F.coalesce(count >= 1, F.lit(False)).alias("has_own_aim_candidate"),
        confidence.alias("confidence"),
    )


def review_reason(notes: Column | None = None, limit: Column | None = None) -> Column:
    """Six reasons in order, then the notes, joined by semicolons; empty without any. limit: what a low confidence lies below, LOW_CONFIDENCE by default."""
    c = F.col
    own, substantive = c("has_own_aim_candidate"), c("is_substantive")
    reasons = [
        F.when(substantive & (F.length("segment_text") < P.SHORT_SEGMENT_CHARS), "short_segment"),
        F.when(substantive & own & (c("aim_candidate_confidence") < (P.LOW_CONFIDENCE if limit is None else limit)), "low_confidence"),
        F.when((c("segment_type") == "body_sentence") & starts_lower(c("segment_text")), "possible_bad_split"),
        F.when(c("is_list_item") & c("parent_segment_id").isNull(), "list_item_no_parent"),
        F.when(c("aim_n_suggested") >= P.HIGH_COUNT, "high_aim_count"),
        F.when(~substantive & own, "context_filter_conflict"),
    ]
    return F.concat_ws(";", *reasons, *([] if notes is None else [notes]))


def reviewed(rows: DataFrame) -> DataFrame:
    """rows with review_reason and needs_review; columns notes and low_confidence are heeded where they come with the rows."""
    notes = F.col("notes") if "notes" in rows.columns else None
    limit = F.col("low_confidence") if "low_confidence" in rows.columns else None
    flagged = rows.withColumn("review_reason", review_reason(notes, limit))
    return flagged.withColumn("needs_review", F.col("review_reason") != "")


def table(rows: DataFrame, system: str | None = None, case: int | None = None, model_version: str | None = None, *more: str) -> DataFrame:
    """The 21 columns in order, doc_id before them and `more` behind; source_base must come with the rows."""
    default = MODEL if "prediction" in rows.columns else HEURISTIC
    filled = rows.withColumns({
        "case_id": F.lit(case).cast("int") if case is not None else case_id(F.col("source_base")), "system": F.lit(system).cast("string"),
        "model_version": F.lit(model_version or default),
    })
    return filled.select("doc_id", *COLUMNS, *more)


def technical(rows: DataFrame) -> DataFrame:
    """The sidecar's rows: doc_id, segment_id, spans, confidence."""
    return rows.select("doc_id", "segment_id", F.col("triggers").cast(TRIGGER).alias("spans"), "confidence")
