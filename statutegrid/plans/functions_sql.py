"""The engine's predicates as SQL functions of a session, for whoever writes queries as text. Catalyst inlines them: no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from statutegrid.functions import lexicon as L
from statutegrid.functions import patterns as P


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(x: str, pattern: str) -> str:
    return f"{x} RLIKE {_q(P.java(pattern))}"


def _ref(pattern: str) -> str:
    return f"nullif(regexp_extract(text, {_q(P.java(pattern))}, 1), '')"


def _definitions() -> dict[str, str]:
    """Signature to body, in the order in which they need each other."""
    bare, end = "strip_text(text)", _q(r"\.+$")
    families = " ".join(f"WHEN {_is('text', pattern)} THEN '{family}'" for family, pattern in P.FAMILIES)
    places = [f"regexp_instr(text, {_q(P.java(p))})" for p in (P.CHAPTER_REF_ES, P.CHAPTER_REF_EN)]
    es, en = _ref(P.CHAPTER_REF_ES), _ref(P.CHAPTER_REF_EN)
    chapter = f"CASE WHEN {es} IS NULL THEN {en} WHEN {en} IS NULL OR {places[0]} < {places[1]} THEN {es} ELSE {en} END"
    rows = ", ".join(f"({_q(lang)}, {n}, {_q(c)}, {_q(lemma)})" for lang, by in L.LEXICON.items() for n, (c, lemmas) in enumerate(by.items()) for lemma in lemmas)
    return {
        "strip_text(text STRING) RETURNS STRING": f"regexp_replace(text, {_q(r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$')}, '')",
        "classify_block(text STRING) RETURNS STRING": f"CASE WHEN {bare} = '' OR {_is(bare, P.start(P.SKIP))} THEN 'SKIP' WHEN {_is(bare, P.start(P.METADATA))} THEN 'METADATA' ELSE 'RELEVANT' END",
        "skip_subtype(text STRING) RETURNS STRING": f"CASE WHEN {_is(bare, P.start(P.SIGNATURE))} THEN 'signature' WHEN {_is(bare, '^' + P.ANNEX)} THEN 'annex' ELSE 'preamble' END",
        "metadata_subtype(text STRING) RETURNS STRING": f"CASE WHEN {_is(bare, '^' + P.ANNEX)} THEN 'annex' ELSE 'heading' END",
        "is_list_line(text STRING) RETURNS BOOLEAN": _is("text", P.LINE_ITEM),
        "marker_family(text STRING) RETURNS STRING": f"CASE {families} ELSE 'bullet' END",
        "article_ref(text STRING) RETURNS STRUCT<title STRING, chapter STRING, article STRING>": "named_struct("
        f"'title', regexp_replace(strip_text({_ref(P.TITLE_REF)}), {end}, ''), 'chapter', regexp_replace(strip_text({chapter}), {end}, ''), "
        f"'article', strip_text(coalesce({_ref(P.ARTICLE_REF)}, {_ref(P.SECTION_REF)})))",
        "lexicon() RETURNS TABLE(language STRING, category_no INT, category STRING, lemma STRING)": f"SELECT * FROM VALUES {rows} AS t(language, category_no, category, lemma)",
        "line_rows(text STRING) RETURNS TABLE(p BIGINT, line STRING)": "SELECT CAST(pos + 1 AS BIGINT), strip_text(col) FROM posexplode(split(text, '\\n'))",
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session, in place of those of an earlier call; their names. They are null of null texts as the columns are."""
    for signature, body in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in _definitions()]
