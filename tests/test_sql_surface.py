"""Functions for SQL give the rows of the DataFrame queries; lookups and flags where accents do not count."""

import pytest
from pyspark.sql import functions as F

from statutegrid.functions import lexicon as L
from statutegrid.functions.text import without_accents
from statutegrid.operators import verbs as V
from statutegrid.plans import catalog, functions_sql
from statutegrid.plans.derived import regulations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql(spark):
    functions_sql.register(spark)
    assert "article_ref" in functions_sql.register(spark)  # a second call replaces the first
    regulations(spark, SF).createOrReplaceTempView("sql_regulations")
    return spark.sql


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    want = want.select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines(spark, sql):
    got = sql("""SELECT doc_id, p, classify_block(line) AS class, CASE classify_block(line) WHEN 'SKIP' THEN skip_subtype(line) WHEN 'METADATA' THEN metadata_subtype(line) END AS subtype,
      is_list_line(line) AS is_item, marker_family(line) AS family FROM sql_regulations, LATERAL line_rows(text)""")
    same(got, catalog.QUERIES["classify_lines"](spark, SF))


def test_references(spark, sql):
    catalog.QUERIES["page_blocks"](spark, SF).createOrReplaceTempView("sql_subs")
    same(sql("SELECT doc_id, block_no, sub_no, r.* FROM (SELECT *, article_ref(text) AS r FROM sql_subs)"), catalog.QUERIES["article_refs"](spark, SF))


def test_lexicon(spark, sql):
    words = catalog.QUERIES["lexicon_lookup"](spark, SF)
    words.createOrReplaceTempView("sql_words")
    same(sql("SELECT w.language, w.lemma, l.category FROM sql_words w LEFT JOIN lexicon() l ON l.language = w.language AND l.lemma = lower(w.lemma)"), words)


def test_odd_texts(sql):
    assert sql("SELECT classify_block(''), classify_block(NULL), marker_family(NULL), is_list_line(NULL), article_ref(NULL).article, article_ref('').title").first()[:] == ("SKIP", "RELEVANT", "bullet", None, None, None)
    assert sql("SELECT classify_block('It\\'s a \\\\ line'), classify_block(repeat('x ', 500000) || 'Artículo 1')").first()[:] == ("RELEVANT", "RELEVANT")


def test_accents_count_unless_folded(spark):
    texts = ["deberá", "podrá", "Los socios tendrán que votar", "deberá hacerlo", "un año", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[V.has_deontic(F.col("t"), F.lit("es"), f).alias(str(f)) for f in (False, True)]).collect()
    assert [r["False"] for r in rows] == [False] * 6 and [r["True"] for r in rows] == [True] * 4 + [False] * 2
    assert spark.range(1).select(V.verb_features(F.lit("Los socios deberán pagar"), F.lit("es"), True)["has_deontic_aux"]).first()[0]
    assert spark.range(1).select(without_accents(F.lit("Añadirá pingüinos, ÉL"))).first()[0] == "Añadira pinguinos, EL"


def test_lookups_without_accents(spark):
    df = spark.createDataFrame([("es", "Áprobar"), ("es", "pagár"), ("es", "definir"), ("es", "defiñir"), ("en", "apprové"), ("es", None)], "language string, lemma string")
    assert [r["category"] for r in L.lookup(df).collect()].count(None) == 5
    assert {r["lemma"]: r["category"] for r in L.lookup(df, folded=True).collect()} == {"Áprobar": "AGG", "pagár": "PAY", "definir": "SCO", "defiñir": None, "apprové": "AGG", None: None}


def test_prefixes_of_lemmas_of_any_length(spark, monkeypatch):
    monkeypatch.setitem(L.LEXICON["es"], "BOU", (*L.LEXICON["es"]["BOU"], "ir"))
    texts = spark.createDataFrame([(1, "es", "Los socios irán y pagarán"), (2, "es", "i"), (3, "es", None)], "doc_id int, language string, text string")
    assert sorted((r["doc_id"], r["lemma"]) for r in V.lexicon_prefixes(texts).collect()) == [(1, "ir"), (1, "pagar")]
