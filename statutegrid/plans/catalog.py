"""Registry of the engine's queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statutegrid.functions import lexicon as L
from statutegrid.functions import patterns as P
from statutegrid.functions.folders import working_folder
from statutegrid.functions.language import detect_language, document_language, word_hits
from statutegrid.operators import blocks as B
from statutegrid.operators import intervals as I
from statutegrid.operators import boundaries as BD
from statutegrid.operators import model as M
from statutegrid.operators import review as R
from statutegrid.operators import segments as G
from statutegrid.operators import structure as S
from statutegrid.operators import verbs as V
from statutegrid.operators.calibration import RANK_ERROR, confidence_limits, confidence_sketches, rank_of
from statutegrid.operators.evaluation import scores
from statutegrid.operators.loss import losses
from statutegrid.operators.pipeline import analysed, run
from statutegrid.operators.sentences import raw_sentences, split_sentences
from statutegrid.operators.summary import reason_counts, summary
from statutegrid.operators.summary import smoke_metrics as metrics
from statutegrid.plans import oracle as O
from statutegrid.plans import functions_sql
from statutegrid.plans.derived import TRANSITIONS, logits, regulations, table
from statutegrid.streaming.pieces import start_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _blocks(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return B.blocks_of(regulations(spark, sf, whole).drop("lang"))


def _events(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return G.events(G.pieces(G.sub_blocks(_blocks(spark, sf, whole))))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- language -----------------------------------------------------------------------------------

_HITS = f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(substr(text, 1, {P.SAMPLE_CHARS})), '[a-záéíóúüñ]+') AS w FROM documents),
h AS (SELECT doc_id, lang, len(list_filter(w, lambda x: x IN {O.words(P.STOPWORDS_ES)})) AS es, len(list_filter(w, lambda x: x IN {O.words(P.STOPWORDS_EN)})) AS en FROM w)"""


@query(f"{_HITS} SELECT doc_id, es::BIGINT AS es, en::BIGINT AS en, CASE WHEN en > es THEN 'en' ELSE 'es' END AS detected FROM h")
def detect_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", word_hits(F.col("text")).alias("h"), detect_language(F.col("text")).alias("detected"))
    return _long(docs.select("doc_id", "h.es", "h.en", "detected"), "es", "en")


@query(f"{_HITS} SELECT lang, CASE WHEN en > es THEN 'en' ELSE 'es' END AS detected, count(*) AS n FROM h GROUP BY ALL")
def language_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
w AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, {P.SAMPLE_CHARS})), '[a-záéíóúüñ]+') AS w FROM t)
SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: x IN {O.words(P.STOPWORDS_EN)})) > len(list_filter(w, lambda x: x IN {O.words(P.STOPWORDS_ES)})) THEN 'en' ELSE 'es' END AS language FROM w""")
def block_language(spark: SparkSession, sf: str) -> DataFrame:
    return document_language(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), "text"))


# ---- blocks and structure -----------------------------------------------------------------------


@query(f"SELECT page_id, {O.strip(f'regexp_replace(html, {O.q(P.HTML_COMMENT)}, {O.q(" ")}, {O.q("g")})')} AS text FROM pages")
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.strip_comments(F.col("html")).alias("text"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n{{2,}}'), lambda x: {O.strip("replace(x, chr(10), ' ')")}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, n - 1 AS block_no, l[n] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM p)""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return _long(B.blocks_of(docs, "txt").drop("page"), "block_no")


@query(O.of("SELECT doc_id, block_no, text FROM blocks"))
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_blocks(spark, sf).select("doc_id", "block_no", "text"), "block_no")


@query(O.of("SELECT doc_id, block_no, sub_no, text, class FROM subs"))
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _long(G.sub_blocks(_blocks(spark, sf)).select("doc_id", "block_no", "sub_no", "text", "class"), "block_no", "sub_no")


@query(O.of("SELECT class, count(*) AS n FROM subs GROUP BY class"))
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.sub_blocks(_blocks(spark, sf)).groupBy("class").agg(F.count("*").alias("n"))


@query(O.of(f"""SELECT doc_id, p, {O.classify('line')} AS class, CASE WHEN {O.classify('line')} = 'SKIP' THEN {O.skip_type('line')} WHEN {O.classify('line')} = 'METADATA' THEN {O.head_type('line')} END AS subtype,
  {O.m('line', P.LINE_ITEM)} AS is_item, {O.family('line')} AS family FROM ln"""))
def classify_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = regulations(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    found = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("p"), S.strip(F.col("line")).alias("line")).withColumn("class", S.classify_block(F.col("line")))
    subtype = F.when(F.col("class") == "SKIP", S.skip_subtype(F.col("line"))).when(F.col("class") == "METADATA", S.metadata_subtype(F.col("line")))
    return found.select("doc_id", "p", "class", subtype.alias("subtype"), S.is_item(F.col("line")).alias("is_item"), S.marker_family(F.col("line")).alias("family"))


@query(O.of(f"SELECT doc_id, p, {O.classify('line')} AS class, {O.family('line')} AS family, article FROM (SELECT *, {O.refs('line')} FROM ln)"))
def sql_line_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, their classes, families and references as a statement of SQL, by the session's functions."""
    functions_sql.register(spark)
    statement = "SELECT doc_id, p, classify_block(line) AS class, marker_family(line) AS family, article_ref(line).article AS article FROM {docs}, LATERAL line_rows(text)"
    return spark.sql(statement, docs=regulations(spark, sf))


@query(O.of(f"SELECT doc_id, block_no, sub_no, {O.refs('text')} FROM subs"))
def article_refs(spark: SparkSession, sf: str) -> DataFrame:
    subs = G.sub_blocks(_blocks(spark, sf)).select("doc_id", "block_no", "sub_no", S.article_ref(F.col("text")).alias("r"))
    return _long(subs.select("doc_id", "block_no", "sub_no", "r.*"), "block_no", "sub_no")


@query(O.of(f"""SELECT doc_id, block_no, sub_no, last_value(article IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no, sub_no) AS article
FROM (SELECT doc_id, block_no, sub_no, {O.refs('text')} FROM subs)"""))
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    so_far = Window.partitionBy("doc_id").orderBy("block_no", "sub_no").rowsBetween(Window.unboundedPreceding, 0)
    refs = article_refs(spark, sf)
    return refs.select("doc_id", "block_no", "sub_no", F.last("article", ignorenulls=True).over(so_far).alias("article"))


@query(O.of("SELECT doc_id, block_no, sub_no, heading, body FROM sub WHERE class = 'METADATA'"))
def heading_bodies(spark: SparkSession, sf: str) -> DataFrame:
    subs = G.sub_blocks(_blocks(spark, sf)).where("class = 'METADATA'").withColumn("h", S.heading_body(F.col("text")))
    return _long(subs.select("doc_id", "block_no", "sub_no", "h.heading", "h.body"), "block_no", "sub_no")


@query(O.of("SELECT doc_id, block_no, sub_no, piece_no, kind, text FROM pieces"))
def pieces(spark: SparkSession, sf: str) -> DataFrame:
    found = G.pieces(G.sub_blocks(_blocks(spark, sf)))
    return _long(found.select("doc_id", "block_no", "sub_no", "piece_no", "kind", "text"), "block_no", "sub_no", "piece_no")


@query(O.of("SELECT doc_id, block_no, sub_no, piece_no, ip[1] AS header, items FROM inl WHERE inline AND line <> ''"))
def inline_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.pieces(G.sub_blocks(_blocks(spark, sf))).where("kind = 'text'").withColumn("l", S.inline_list(F.col("text"))).where("l IS NOT NULL")
    return _long(rows.select("doc_id", "block_no", "sub_no", "piece_no", "l.header", "l.items"), "block_no", "sub_no", "piece_no")


@query(f"SELECT doc_id, {O.sentences('text')} AS raw, {O.merged(O.sentences('text'))} AS sentences FROM documents")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", raw_sentences(F.col("text")).alias("raw"), split_sentences(F.col("text")).alias("sentences"))


@query(f"WITH {BD.sql()} SELECT word, n, pointed, round(score, 4) AS score FROM short")
def learnt_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    found = BD.abbreviations(BD.word_counts(table(spark, sf, "documents")))
    return found.select("word", "n", "pointed", F.round("score", 4).alias("score"))


@query(f"""WITH {BD.sql(P.ABBREVIATIONS)}, whole AS (SELECT doc_id, string_split(string_agg(piece || CASE WHEN goes_on THEN '' ELSE {O.UNIT} END, '' ORDER BY n), {O.UNIT}) AS l FROM judged GROUP BY doc_id)
SELECT doc_id, list_filter(list_transform(l, lambda x: {O.strip("x")}), lambda x: x <> '') AS raw FROM whole""")
def learnt_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences cut by abbreviations that the same documents show, besides the listed ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = BD.going_on(docs, BD.word_counts(docs), prior=P.ABBREVIATIONS)
    return BD.with_sentences(docs, pairs, "doc_id").select("doc_id", "raw")


@query(O.of("SELECT doc_id, block_no, sub_no, piece_no, emit_no, kind, type, text, family FROM events"))
def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("doc_id", "block_no", "sub_no", "piece_no", "emit_no", "kind", "type", "text", "family")
    return _long(rows, "block_no", "sub_no", "piece_no", "emit_no")


@query(O.of("SELECT doc_id, block_no, sub_no, piece_no, emit_no, run::BIGINT AS run, closed, splits FROM list_state"))
def list_parents(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.list_state(_events(spark, sf, True)).select("doc_id", "block_no", "sub_no", "piece_no", "emit_no", "run", "closed", "splits")
    return _long(rows, "block_no", "sub_no", "piece_no", "emit_no", "run")


@query(O.of(f"SELECT doc_id, {', '.join(R.COLUMNS)} FROM final", True))
def segments(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: documents to the reviewed table of 21 columns."""
    return run(_blocks(spark, sf, True))[0]


@query(O.of(f"SELECT doc_id, {', '.join(R.COLUMNS)} FROM final", True))
def arriving_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's table from blocks that arrive in three parts, every third block first, those before it later; the stream ends and starts again between the parts."""
    folder = working_folder(spark, "arriving")
    cut = _blocks(spark, sf).select("doc_id", "source_base", "block_no", "text", (F.col("block_no") % 3).alias("part"))
    cut.write.partitionBy("part").parquet(f"{folder}/blocks")  # documents are cut into blocks once, not for each part
    blocks = spark.read.schema(cut.schema).parquet(f"{folder}/blocks").select("*", F.current_timestamp().alias("arrived"))
    for part in (2, 0, 1):
        blocks.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(blocks.drop("part").schema).parquet(f"{folder}/in")
        start_pieces(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(O.of("SELECT s.doc_id, s.segment_id, s.segment_text, p.segment_text AS parent_text FROM segments s LEFT JOIN segments p ON p.doc_id = s.doc_id AND p.segment_id = s.parent_segment_id"))
def parent_text(spark: SparkSession, sf: str) -> DataFrame:
    return G.segment(_blocks(spark, sf, True), parents=True).select("doc_id", "segment_id", "segment_text", "parent_text")


# ---- verbs --------------------------------------------------------------------------------------

_REG_SQL = f"array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: {O.LINE.format(p='(i + doc_id)')}), chr(10))"
_SPOKEN = f"spoken AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS language, coalesce({_REG_SQL}, '') AS text FROM documents)"


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Whole regulations; what is not English is read as Spanish, and null texts as empty ones."""
    return regulations(spark, sf).select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("es").alias("language"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {_SPOKEN} SELECT doc_id, CASE WHEN language = 'en' THEN {O.m('text', P.DEONTIC_RE_EN)} ELSE {O.m('text', P.DEONTIC_RE_ES)} END AS has_deontic_aux FROM spoken")
def deontic_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _spoken(spark, sf).select("doc_id", V.has_deontic(F.col("text"), F.col("language")).alias("has_deontic_aux"))


@query(f"WITH {_SPOKEN} SELECT doc_id, CASE WHEN language = 'en' THEN {O.m('text', P.DEONTIC_RE_EN)} ELSE {O.m(O.FOLDED.format('text'), P.DEONTIC_RE_ES)} END AS has_deontic_aux FROM spoken")
def deontic_flags_folded(spark: SparkSession, sf: str) -> DataFrame:
    """The same where accents do not count."""
    return _spoken(spark, sf).select("doc_id", V.has_deontic(F.col("text"), F.col("language"), True).alias("has_deontic_aux"))


@query(f"WITH {_SPOKEN}, {O.aims('spoken', 'doc_id')} SELECT doc_id, verb, lemma, position, suggested_type FROM aims")
def extract_aims(spark: SparkSession, sf: str) -> DataFrame:
    return _spoken(spark, sf).select("doc_id", F.inline(V.extract_aims(F.col("text"), F.col("language"))))


@query(f"""WITH lex(language, category_no, category, lemma) AS (VALUES {O.lexicon_rows()}), w AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS language, unnest(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS lemma FROM documents)
SELECT w.language, w.lemma, lex.category FROM w LEFT JOIN lex USING (language, lemma)""")
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-záéíóúñü]+"), F.lit(0))
    language = F.when(F.col("lang") == "en", "en").otherwise("es")
    rows = table(spark, sf, "documents").select(language.alias("language"), F.explode(words).alias("lemma"))
    return L.lookup(rows.distinct())


@query(f"""WITH lex(language, category_no, category, lemma) AS (VALUES {O.lexicon_rows()}), w AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS language, unnest(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS lemma FROM documents),
a AS (SELECT language, replace(lemma, 'i', 'í') AS lemma FROM w)
SELECT a.language, a.lemma, lex.category FROM a LEFT JOIN lex ON lex.language = a.language AND lex.lemma = {O.FOLDED.format('a.lemma')}""")
def lexicon_lookup_folded(spark: SparkSession, sf: str) -> DataFrame:
    """All words, each i with an accent that it should not have, looked up where accents do not count."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-záéíóúñü]+"), F.lit(0))
    language = F.when(F.col("lang") == "en", "en").otherwise("es")
    rows = table(spark, sf, "documents").select(language.alias("language"), F.explode(words).alias("lemma")).distinct()
    return L.lookup(rows.withColumn("lemma", F.replace("lemma", F.lit("i"), F.lit("í"))), folded=True)


@query(f"""WITH {_SPOKEN}, lex(language, category_no, category, lemma) AS (VALUES {O.lexicon_rows()}),
w AS (SELECT DISTINCT doc_id, language, unnest(regexp_extract_all(lower(text), '[\\p{{L}}0-9_]+')) AS word FROM spoken)
SELECT DISTINCT doc_id, category_no, category, lex.lemma FROM w JOIN lex ON lex.language = w.language AND starts_with(word, lex.lemma)""")
def lexicon_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return V.lexicon_prefixes(_spoken(spark, sf))


@query(f"""WITH {_SPOKEN}, {O.aims('spoken', 'doc_id')}, f AS (SELECT doc_id, count(*) AS n, string_agg(lemma, ';' ORDER BY n) AS lemmas FROM aims GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(suggested_type, ';' ORDER BY n) AS categories FROM (SELECT doc_id, suggested_type, min(n) AS n FROM aims WHERE suggested_type IS NOT NULL GROUP BY doc_id, suggested_type) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_institutional_verbs, coalesce(lemmas, '') AS verb_lemmas, coalesce(categories, '') AS verb_categories FROM spoken LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)""")
def verb_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spoken(spark, sf).withColumn("v", V.verb_features(F.col("text"), F.col("language")))
    return rows.select("doc_id", F.col("v.n_institutional_verbs").cast("long").alias("n_institutional_verbs"), F.col("v.verb_lemmas_text").alias("verb_lemmas"), F.col("v.verb_categories_text").alias("verb_categories"))


@query(f"""WITH {_SPOKEN}, {O.aims('spoken', 'doc_id')}, spans AS (SELECT doc_id, s::INT AS start, (s + 200)::INT AS "end" FROM (SELECT doc_id, unnest(range(0, length(text), 200)) AS s FROM spoken))
SELECT doc_id, start, verb, position FROM (SELECT s.doc_id, s.start, a.verb, a.position, row_number() OVER (PARTITION BY s.doc_id, s.start ORDER BY a.position) AS k FROM spans s JOIN aims a ON a.doc_id = s.doc_id AND a.position >= s.start AND a.position < s."end") WHERE k = 1""")
def trigger_containment(spark: SparkSession, sf: str) -> DataFrame:
    """First verb inside each span of 200 characters: two tables, one sweep."""
    spans, verbs = _spans(spark, sf, 200, 200), extract_aims(spark, sf)
    return I.first_inside(spans, verbs, "doc_id").where("point IS NOT NULL").select("doc_id", "start", "point.verb", "point.position")


def _spans(spark: SparkSession, sf: str, step: int, width: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)))
    return _spoken(spark, sf).where(F.length("text") > 0).select("doc_id", starts.alias("start")).withColumn("end", F.col("start") + width)


@query(f"""WITH {_SPOKEN}, {O.aims('spoken', 'doc_id')}, spans AS (SELECT doc_id, s::INT AS start, (s + 300)::INT AS "end" FROM (SELECT doc_id, unnest(range(0, length(text), 100)) AS s FROM spoken))
SELECT s.doc_id, s.start, a.verb, a.position FROM spans s JOIN aims a ON a.doc_id = s.doc_id AND a.position >= s.start AND a.position < s."end\"""")
def verbs_inside(spark: SparkSession, sf: str) -> DataFrame:
    """All verbs inside each of the spans of 300 characters, one every 100."""
    return I.all_inside(_spans(spark, sf, 100, 300), extract_aims(spark, sf).select("doc_id", "verb", "position"), "doc_id").select("doc_id", "start", "verb", "position")


# ---- review -------------------------------------------------------------------------------------


@query(O.of("SELECT doc_id, segment_id, needs_review, review_reason FROM final", True))
def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("doc_id", "segment_id", "needs_review", "review_reason")


@query(O.of("SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, unnest(string_split(review_reason, ';')) AS reason FROM final WHERE review_reason <> '') WHERE reason <> '' GROUP BY ALL", True))
def review_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reason_counts(segments(spark, sf))


_PY = "CASE WHEN {0} THEN 'True' ELSE 'False' END"


@query(O.of(f"""SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY CASE WHEN section_no = 5 THEN 0 ELSE -n END, key_text)::INT AS rank, section, key_text, n::VARCHAR AS value FROM (
  SELECT doc_id, section_no, section, key_text, count(*) AS n FROM (
    SELECT doc_id, 1 AS section_no, 'segment_type' AS section, segment_type AS key_text FROM final UNION ALL SELECT doc_id, 2, 'is_substantive', {_PY.format('is_substantive')} FROM final
    UNION ALL SELECT doc_id, 3, 'needs_review', {_PY.format('needs_review')} FROM final UNION ALL SELECT doc_id, 4, 'review_reason', unnest(string_split(review_reason, ';')) FROM final WHERE review_reason <> ''
    UNION ALL SELECT doc_id, 5, 'aim_n_suggested', aim_n_suggested::VARCHAR FROM final WHERE is_substantive) GROUP BY ALL)
UNION ALL SELECT doc_id, 0, k, 'document', ['case_id', 'source_base', 'model_version', 'n_segments'][k], [doc_id::VARCHAR, doc_id || '. Reglamento.md', 'heuristic_extractor', n::VARCHAR][k]
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id))""", True))
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return summary(segments(spark, sf))


@query(O.of("""SELECT doc_id, segment_id, '{"spans":[' || coalesce(string_agg('{"surface":' || to_json(verb) || ',"lemma":' || to_json(lemma) || ',"start":' || position || ',"span_text":' || to_json(segment_text) || '}', ',' ORDER BY position), '') || ']}' AS technical
FROM segments LEFT JOIN aims USING (doc_id, segment_order) GROUP BY doc_id, segment_id""", True))
def technical_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.technical(analysed(_blocks(spark, sf, True)))
    return rows.select("doc_id", "segment_id", F.to_json(F.struct("spans", "confidence")).alias("technical"))


@query(O.of("""SELECT count(*) AS n_segments, count(*) FILTER (is_substantive) AS n_substantive, count(*) FILTER (is_substantive AND has_own_aim_candidate) AS n_with_candidate,
  count(*) FILTER (is_list_item) AS n_list_items, count(*) FILTER (needs_review) AS n_needs_review, count(*) FILTER (needs_review)::DOUBLE / count(*) AS share_needs_review FROM final""", True))
def smoke_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(segments(spark, sf))


@query(f"""WITH {_SPOKEN}, {O.aims('spoken', 'doc_id')}, lex(language, category_no, category, lemma) AS (VALUES {O.lexicon_rows()}),
f AS (SELECT doc_id, string_agg(lemma, ';' ORDER BY n) AS lemmas FROM aims GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(suggested_type, ';' ORDER BY n) AS categories FROM (SELECT doc_id, suggested_type, min(n) AS n FROM aims WHERE suggested_type IS NOT NULL GROUP BY doc_id, suggested_type) GROUP BY doc_id),
w AS (SELECT DISTINCT doc_id, language, unnest(regexp_extract_all(lower(text), '[\\p{{L}}0-9_]+')) AS word FROM spoken WHERE doc_id NOT IN (SELECT doc_id FROM f)),
x AS (SELECT DISTINCT doc_id, category_no, category, lex.lemma FROM w JOIN lex ON lex.language = w.language AND starts_with(word, lex.lemma)),
xl AS (SELECT doc_id, string_agg(lemma, ';' ORDER BY category_no, -length(lemma), lemma) AS lemmas FROM x GROUP BY doc_id),
xc AS (SELECT doc_id, string_agg(category, ';' ORDER BY category_no) AS categories FROM (SELECT DISTINCT doc_id, category_no, category FROM x) GROUP BY doc_id)
SELECT doc_id, coalesce(f.lemmas, xl.lemmas, '') AS verb_lemmas, coalesce(CASE WHEN f.lemmas IS NULL THEN xc.categories ELSE c.categories END, '') AS verb_categories
FROM spoken LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN xl USING (doc_id) LEFT JOIN xc USING (doc_id)""")
def verb_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.with_fallback(_spoken(spark, sf))
    return rows.select("doc_id", F.col("features.verb_lemmas_text").alias("verb_lemmas"), F.col("features.verb_categories_text").alias("verb_categories"))


@query("SELECT doc_id, doc_id::INT AS from_name, NULL::INT AS from_other FROM documents")
def case_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", R.case_id(F.format_string("  %d. Reglamento.md", "doc_id")).alias("from_name"), R.case_id(F.format_string("Reglamento %d.md", "doc_id")).alias("from_other"))


# ---- model outputs ------------------------------------------------------------------------------


@query(f"WITH {O.LOGITS} SELECT vec_id, array_to_string(tags, '') AS tags FROM tags")
def argmax_tags(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", F.array_join(M.argmax_tags(F.col("logits")), "").alias("tags"))


@query(O.viterbi())
def viterbi_tags(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", F.array_join(M.viterbi_tags(F.col("logits"), TRANSITIONS), "").alias("tags"))


@query(f"""WITH {O.LOGITS}, {O.spans('tags')} SELECT vec_id, s AS start, e AS "end", t AS text FROM spans WHERE t <> ''""")
def bio_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = logits(spark, sf).withColumn("tags", M.argmax_tags(F.col("logits")))
    return rows.select("vec_id", F.inline(M.bio_spans(F.col("tags"), F.col("offsets"), F.col("text"))))


@query(f"""WITH {O.LOGITS}, {O.spans('tags')}, c AS (SELECT vec_id, count(*) AS n FROM spans WHERE t <> '' GROUP BY vec_id)
SELECT vec_id, len(list_filter(tags, lambda x: x = 1))::INT AS begins, coalesce(n, 0)::INT AS count, len(list_filter(ordinals, lambda x: x > 0))::INT AS ordinal_count, least(coalesce(n, 0), {P.BUCKET_CAP})::INT AS aim_n_bucket FROM tags LEFT JOIN c USING (vec_id)""")
def aim_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = logits(spark, sf).withColumn("p", M.prediction(F.col("logits"), F.col("offsets"), F.col("ordinals"), F.col("text")))
    return rows.select("vec_id", M.count_begins(M.argmax_tags(F.col("logits"))).alias("begins"), "p.count", "p.ordinal_count", "p.aim_n_bucket")


@query(f"""WITH {O.LOGITS}, p AS (SELECT vec_id, i, list_transform(logits[i], lambda x: exp(x - list_max(logits[i]))) AS e, tags[i] AS tag FROM (SELECT *, unnest(range(2, 22)) AS i FROM tags))
SELECT vec_id, round(avg(e[tag + 1] / list_sum(e)), 6) AS confidence FROM p GROUP BY vec_id""")
def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    special = F.transform("offsets", lambda o: (o["start"] == 0) & (o["end"] == 0))
    rows = logits(spark, sf).withColumn("tags", M.argmax_tags(F.col("logits")))
    return rows.select("vec_id", F.round(M.mean_confidence(F.col("logits"), F.col("tags"), special), 6).alias("confidence"))


@query(O.losses())
def training_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The loss of the vectors' scores, in five batches, against labels that follow from their numbers; the first token has none."""
    rows = logits(spark, sf).withColumn("aim_n", (F.col("vec_id") % 4).cast("int")).withColumn("batch", F.col("vec_id") % 5)
    labels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(i == 0, -100).otherwise((F.col("vec_id") + i) % 3).cast("int"))
    rows = rows.withColumn("labels", labels).withColumn("ordinal_labels", F.array(*[(F.col("aim_n") >= k).cast("int") for k in (1, 2, 3)])).withColumnRenamed("ordinals", "ordinal_logits")
    found = losses(rows, "batch", TRANSITIONS)
    return found.select("batch", "n", *[F.round(c, 6).alias(c) for c in ("span_loss", "ordinal_loss", "penalty", "loss")])


@query(O.evaluation())
def prediction_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors' predictions by four versions against spans of two tokens, 5 to 27 tokens apart; one vector in seven has no count, another a negative one."""
    rows = logits(spark, sf).withColumn("p", M.prediction(F.col("logits"), F.col("offsets"), F.col("ordinals"), F.col("text")))
    apart = F.col("vec_id") % 23 + 5
    tags = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when((F.col("vec_id") + i) % apart == 0, 1).when((F.col("vec_id") + i) % apart == 1, 2).otherwise(0))
    held = rows.withColumn("gold_spans", M.bio_spans(tags, F.col("offsets"), F.col("text")))
    count = F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 7 == 1, -1).otherwise(F.size("gold_spans"))
    found = scores(held.select((F.col("vec_id") % 4).alias("version"), "p.count", "p.spans", count.alias("gold_count"), "gold_spans"), "version")
    return found.select("version", "n", "n_excluded", *[F.round(c, 6).alias(c) for c in found.columns[3:]])


@query(f"""WITH {O.LOGITS}, p AS (SELECT vec_id, i, list_transform(logits[i], lambda x: exp(x - list_max(logits[i]))) AS e, tags[i] AS tag FROM (SELECT *, unnest(range(2, 22)) AS i FROM tags)),
c AS (SELECT vec_id, avg(e[tag + 1] / list_sum(e)) AS confidence FROM p GROUP BY vec_id)
SELECT vec_id % 3 AS version, count(*) AS n, true AS within_bound FROM c WHERE confidence IS NOT NULL GROUP BY ALL""")
def confidence_fifths(spark: SparkSession, sf: str) -> DataFrame:
    """By version the limit from the sketches of four runs, merged, and whether its rank is within the sketch's bound of the exact fifth."""
    special = F.transform("offsets", lambda o: (o["start"] == 0) & (o["end"] == 0))
    tagged = logits(spark, sf).withColumn("tags", M.argmax_tags(F.col("logits")))
    rows = tagged.select((F.col("vec_id") % 3).alias("version"), (F.col("vec_id") % 4).alias("run"), M.mean_confidence(F.col("logits"), F.col("tags"), special).alias("confidence"))
    runs = confidence_sketches(rows.withColumn("of", F.struct("version", "run")), "of").select("of.version", "n", "sketch")
    limits = confidence_limits(runs, 0.2, 1, "version")
    ranked = rows.join(F.broadcast(limits.drop("n")), "version").groupBy("version").agg(F.count("confidence").alias("n"), rank_of(F.col("low_confidence"), F.col("confidence")).alias("r"))
    # twice the bound, which holds with probability 0.99 only; a sketch of n rows gives one of them, so ranks are off by up to a row besides
    return ranked.select("version", "n", (F.abs(F.col("r") - 0.2) <= RANK_ERROR * 2 + 1 / F.col("n")).alias("within_bound"))


def stub_model() -> object:
    """A model that marks the first 20 characters of any text."""

    class Stub:
        def predict(self, text: str) -> object:
            end = min(20, len(text))
            return SimpleNamespace(spans=[(0, end, text[:end])], count=1, confidence=0.88)

    return Stub()


_OWN = "owned AS (SELECT doc_id, segment_order, substr(segment_text, 1, 20) AS text, 'es' AS language FROM segments), whole AS (SELECT doc_id, segment_order, segment_text AS text, 'es' AS language FROM segments)"
_KEY = "doc_id segment_order"


@query(O.of(f"""SELECT s.doc_id, segment_id, 1 AS aim_n_suggested, substr(segment_text, 1, 20) AS aim_text_candidate, coalesce(o.verb, i.verb, a.verb, '') AS aim_trigger_candidate,
  0.88::DOUBLE AS aim_candidate_confidence, true AS has_own_aim_candidate, 'model-1.0' AS model_version
FROM segments s LEFT JOIN (SELECT doc_id, segment_order, min_by(verb, n) AS verb FROM owns GROUP BY ALL) o USING (doc_id, segment_order)
  LEFT JOIN (SELECT doc_id, segment_order, min_by(verb, n) AS verb FROM wholes WHERE position < 20 GROUP BY ALL) i USING (doc_id, segment_order)
  LEFT JOIN (SELECT doc_id, segment_order, min_by(verb, n) AS verb FROM anys GROUP BY ALL) a USING (doc_id, segment_order)""",
    more=f"{_OWN}, {O.aims('owned', _KEY, 'owns')}, {O.aims('whole', _KEY, 'wholes')}, {O.aims('owned', _KEY, 'anys', True)}"))
def model_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The same table with a model plugged in; a span's verb is its own text's, else the segment's first inside it, else any verb of its text."""
    found, _ = run(_blocks(spark, sf, True), load_model=stub_model)
    return found.select("doc_id", "segment_id", "aim_n_suggested", "aim_text_candidate", "aim_trigger_candidate", "aim_candidate_confidence", "has_own_aim_candidate", "model_version")
