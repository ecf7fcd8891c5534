"""Each segment goes through a model once, whatever is written; plans have one scan and one exchange; work grows with the text."""

import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import statutegrid
from statutegrid import cli
from statutegrid.functions import patterns as P
from statutegrid.operators import analyzer as A
from statutegrid.operators import verbs as V
from statutegrid.operators.model import Scorer
from statutegrid.operators.review import technical
from statutegrid.operators.segments import segment
from statutegrid.operators.sentences import merge_fragments, split_sentences
from statutegrid.operators.structure import inline_list, page_blocks
from statutegrid.plans import catalog
from statutegrid.sources import models
from statutegrid.streaming import files as stream

SF = "/root/testdata/sf0.001"
MD = "# Capítulo 1. De los socios\nLos socios deberán aprobar la cuota anual. Son obligaciones de los socios:\n- a) pagar\n- b) asistir a todo\n"


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        class Model:
            def predict(self, text):
                calls.add(1)
                return SimpleNamespace(spans=[(0, 5, text[:5])], count=1, confidence=0.9)

        return Model()

    return calls, load


def test_tables_cost_one_model_call_a_segment(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}. R.md").write_text(MD * (n + 1), encoding="utf-8")
    calls, load = counting(spark)
    rows = statutegrid.analysed(statutegrid.read_blocks(spark, f"{tmp_path}/*.md"), "auto", load)
    statutegrid.write_analysis(rows, f"{tmp_path}/out")
    back = {n: spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("segments", "summary", "schema", "technical")}
    assert back["segments"].count() == back["technical"].count() == calls.value > 0
    assert back["segments"].columns == ["doc_id", *statutegrid.COLUMNS] and not (tmp_path / "out" / "analysed").exists()
    assert {r["value"] for r in back["summary"].where("key_text = 'n_segments'").collect()} == {str(r["count"]) for r in back["segments"].groupBy("doc_id").count().collect()}


def test_a_workbook_costs_one_model_call_a_segment(spark, tmp_path):
    (tmp_path / "1. R.md").write_text(MD, encoding="utf-8")
    calls, load = counting(spark)
    cli.run_file(spark, str(tmp_path / "1. R.md"), load_model=load, language="es")
    assert calls.value == 5


@pytest.mark.parametrize("name", ["summaries", "parent_text", "segments", "smoke_metrics"])
def test_one_scan_and_one_exchange_by_document(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning(doc_id") == 1 and "Join" not in plan
    assert plan.count("Exchange") == (2 if name == "smoke_metrics" else 1)  # one row of all has an exchange of partial counts


def test_a_language_of_each_document_takes_no_second_look(spark, tmp_path):
    from statutegrid.functions.language import detect_language, with_language
    from statutegrid.operators.pipeline import run

    plan = run(catalog._blocks(spark, SF, True), "auto")[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    (tmp_path / "1. R.md").write_text(MD, encoding="utf-8")
    rows = statutegrid.analysed(statutegrid.read_blocks(spark, f"{tmp_path}/*.md"), "auto")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rng = random.Random(7)
    docs = [(d, n, rng.choice(["the members of the ditch ", "los socios de la acequia ", "nada "]) * rng.choice([1, 40, 900])) for d in range(40) for n in range(rng.randrange(1, 6))]
    docs += [(90, 0, "x" * (P.SAMPLE_CHARS - 8)), (90, 1, "el la the the the"), (91, 0, None), (91, 1, "the of")]
    blocks = spark.createDataFrame(docs, "doc_id int, block_no int, text string")
    got = {r["doc_id"]: r["language"] for r in with_language(blocks).collect()}
    texts = {}
    for d, _, t in docs:
        texts[d] = (texts[d] + " " if d in texts else "") + (t or "")
    want = spark.createDataFrame(list(texts.items()), "doc_id int, text string").select("doc_id", detect_language(F.col("text")).alias("l")).collect()
    assert got == {r["doc_id"]: r["l"] for r in want} and got[90] == "es"


def test_parents_by_window_are_those_of_the_join(spark):
    from statutegrid.operators.segments import parent_text

    blocks = catalog._blocks(spark, SF, True)
    key = lambda df: sorted((r["doc_id"], r["segment_id"], r["parent_text"] or "") for r in df.collect())
    assert key(segment(blocks, parents=True)) == key(parent_text(segment(blocks)))


def seconds(spark, n):
    text = "Los socios votan en cada sesión de la asamblea. " * n
    df = spark.createDataFrame([(text,)], "text string").select(F.size(split_sentences(F.col("text"))))
    best = []
    for _ in range(2):
        began = time.time()
        assert df.first()[0] == n
        best.append(time.time() - began)
    return min(best)


def test_time_grows_in_proportion_to_sentences(spark):
    seconds(spark, 100)
    few, many = seconds(spark, 16_000), seconds(spark, 64_000)
    assert many <= 8 * few + 1  # four times as many; sixteen times the time if it were quadratic


def sentences(spark, text):
    return one(spark, split_sentences(F.lit(text)))


def test_abbreviations_and_initials_end_no_sentence(spark):
    assert sentences(spark, "El Sr. Presidente de la comunidad convocará la sesión. La Dra. D. A. Pérez la dirige siempre.") == ["El Sr. Presidente de la comunidad convocará la sesión.", "La Dra. D. A. Pérez la dirige siempre."]
    assert sentences(spark, "The U.S. National Water Board shall pay the fee. Mr. Smith keeps the books of the board.") == ["The U.S. National Water Board shall pay the fee.", "Mr. Smith keeps the books of the board."]
    assert sentences(spark, "Véase el art. 5 de estos estatutos. Los socios podrán votar en ella.") == ["Véase el art. 5 de estos estatutos.", "Los socios podrán votar en ella."]


def folded(sentences):
    """Fragments put together by a plain loop over whole buffers."""
    done, buffer = [], None
    for x in sentences:
        if buffer is None:
            buffer = x
            continue
        takes = re.search(P.BARE_LABEL, buffer, re.I) or re.search(P.SHORT_COLON, buffer, re.I)
        part = re.search(P.SENTENCE_ITEM, x, re.I) or re.search(P.DIGIT_CONTINUATION, x) or re.search(P.LOWERCASE_START, x) or len(x) < P.SHORT_FRAGMENT_CHARS
        if takes or part:
            buffer += " " + x
        else:
            done.append(buffer)
            buffer = x
    return done + ([buffer] if buffer is not None else [])


def test_fragments_are_those_of_a_plain_loop_over_any_number_of_chunks(spark):
    rng = random.Random(4)
    kinds = ["Los socios votan en cada sesión de la asamblea.", "1. DUES:", "2.", "a)", "y algo más que sigue aquí abajo.", "Corto.", "a) un punto de la lista.", "3 veces al año se reúne.", "X" * 60 + ":", "El cuerpo ejecutivo de la comunidad:", "B) Otro punto de la lista."]
    rows = [(n, [rng.choice(kinds) for _ in range(size)]) for n, size in enumerate([0, 1, 2, 3, 255, 256, 257, 513, 900, *range(4, 40)])]
    got = {r["n"]: r["m"] for r in spark.createDataFrame(rows, "n int, s array<string>").select("n", merge_fragments(F.col("s")).alias("m")).collect()}
    assert got == {n: folded(s) for n, s in rows}


def test_control_characters_cut_nothing(spark):
    for c in "\u001c\u001d\u001e\u001f":
        text = f"Los socios de la comunidad{c}votan siempre en la asamblea general."
        assert sentences(spark, text) == [text]
        assert one(spark, page_blocks(F.lit(text * 10))) == [text * 10]
        assert one(spark, inline_list(F.lit(f"Los turnos{c}son: a) uno; b) dos")))["header"] == f"Los turnos{c}son:"


def aims(spark, text, language):
    return [(h["verb"], h["lemma"], h["suggested_type"]) for h in one(spark, V.extract_aims(F.lit(text), F.lit(language)))]


def test_verbs_behind_modals(spark):
    for text, language, want in (
        ("The owner shall promptly repair the canal.", "en", [("shall", "shall", None), ("repair", "repair", None)]),
        ("Members who steal shall be expelled.", "en", [("shall", "shall", None), ("expelled", "expel", "BOU")]),
        ("The fee must have been paid.", "en", [("must", "must", None), ("paid", "pay", "PAY")]),
        ("The board shall be responsible for it.", "en", [("shall", "shall", None)]),
        ("The report of the use of the record.", "en", []),
        ("They may also inspect the nets and report the use.", "en", [("may", "may", None), ("inspect", "inspect", None), ("report", "report", "INF")]),
        ("Los socios deberán nunca pescar de noche.", "es", [("deberán", "deber", None), ("pescar", "pescar", None)]),
        ("El usuario tendrá que reparar la acequia.", "es", [("tendrá", "tener", None), ("reparar", "reparar", None)]),
        ("La junta habrá de convocarla inmediatamente.", "es", [("habrá", "haber", None), ("convocarla", "convocar", "AGG")]),
        ("Podrán los vecinos votar.", "es", [("Podrán", "poder", None), ("votar", "votar", "AGG")]),
        ("La multa no se publica.", "es", [("publica", "publicar", "INF")]),
    ):
        assert aims(spark, text, language) == want, text


def test_the_first_verb_need_not_be_in_the_lexicon(spark):
    first = lambda t, lang: tuple(one(spark, V.first_verb(F.lit(t), F.lit(lang))))
    assert first("The water is clean and members vote", "en") == ("is", "is") and first("Nothing here", "en") == ("", "")
    assert first("El agua está limpia", "es") == ("está", "está") and first("Deberá pagar", "es") == ("Deberá", "deber")


def test_features_fall_back_to_words_that_begin_like_lemmas(spark):
    df = spark.createDataFrame([(1, "en", "payment of fines"), (2, "en", "Members shall vote"), (3, "es", "nada"), (4, "es", "")], "doc_id int, language string, text string")
    got = {r["doc_id"]: (r["features"]["verb_lemmas_text"], r["features"]["verb_categories_text"], r["features"]["n_institutional_verbs"]) for r in V.with_fallback(df).collect()}
    assert got == {1: ("fine;pay", "PAY", 2), 2: ("shall;vote", "AGG", 2), 3: ("", "", 0), 4: ("", "", 0)}


class Parser:
    """Knows one sentence, and cuts at semicolons."""

    def sentences(self, texts, language):
        return [t.split(";") for t in texts]

    def tokens(self, texts, languages):
        known = [("Members", "member", "NOUN", "nsubj", 0, 4), ("may", "may", "AUX", "aux", 8, 4), ("at", "at", "ADP", "prep", 12, 4), ("cost", "cost", "NOUN", "pobj", 15, 2), ("inspect", "inspect", "VERB", "ROOT", 20, 4), ("to", "to", "PART", "aux", 28, 6), ("report", "report", "VERB", "xcomp", 31, 4), ("use", "use", "NOUN", "dobj", 38, 6), ("go", "go", "VERB", "relcl", 42, 7)]
        return [known if t.startswith("Members may") else [] for t in texts]


def test_an_analyzer_takes_the_place_of_the_rules(spark):
    df = spark.createDataFrame([("Members may at cost inspect to report use go",), ("other",)], "segment_text string").withColumn("language", F.lit("en"))
    got = A.with_tokens(df, Parser).select("segment_text", A.aims_of_tokens(F.col("tokens"), F.col("language")).alias("a"))
    assert {r["segment_text"][:3]: [tuple(h) for h in r["a"]] for r in got.collect()} == {"Mem": [("may", "may", 8, None), ("inspect", "inspect", 20, None), ("report", "report", 31, "INF")], "oth": []}
    blocks = spark.createDataFrame([("d", "1. x.md", 0, None, "Members may at cost inspect to report use go; Another sentence of this kind")], "doc_id string, source_base string, block_no int, page int, text string")
    table, rows = statutegrid.run(blocks, "en", load_analyzer=Parser)
    found = table.orderBy("segment_order").collect()
    assert [(r["segment_text"], r["aim_n_suggested"], r["aim_trigger_candidate"]) for r in found] == [("Members may at cost inspect to report use go", 3, "may | inspect | report"), ("Another sentence of this kind", 0, "")]
    assert len(technical(rows).first()["spans"]) in (0, 3)


def runner(name, settings):
    class Scores:
        def scores(self, texts):
            for t in texts:
                words, at, logits = t.split(), [(0, 0)], [[0.0, 0.0, 9.0]]
                for n, w in enumerate(words):
                    start = t.index(w, at[-1][1])
                    at.append((start, start + len(w)))
                    logits.append([0.0, 2.0, 0.0] if n == 1 else [2.0, 0.0, 0.0])
                yield logits, at, [1.0, -1.0, -1.0]

    return Scores()


def test_a_folder_of_weights_decides_how_scores_are_decoded(spark, tmp_path, monkeypatch):
    (tmp_path / "model.safetensors").touch()
    blocks = spark.createDataFrame([("d", "1. x.md", 0, None, "Los socios votan en cada sesión")], "doc_id string, source_base string, block_no int, page int, text string")
    counts = {}
    for crf in (True, False):
        (tmp_path / "training_config.json").write_text('{"use_crf": %s, "transitions": [[0, -9, 0], [0, -9, 0], [0, -9, 0]]}' % str(crf).lower())
        load = models.scorer(str(tmp_path), runner)
        assert isinstance(load, Scorer) and (load.transitions is not None) == crf
        counts[crf] = statutegrid.run(blocks, "es", load)[0].first()["aim_n_suggested"]
    assert counts == {True: 0, False: 1}
    assert cli.parser().parse_args(["a.md", "--runner", "m:f", "--analyzer", "m:g"]).runner == "m:f"
    monkeypatch.setattr("collections.some_runner", runner, raising=False)
    assert isinstance(cli.model_loader(str(tmp_path), "collections:some_runner"), Scorer)
    with pytest.raises(FileNotFoundError):
        cli.model_loader("./none", "collections:some_runner")


def test_a_stream_writes_its_technical_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1. R.md").write_text(MD, encoding="utf-8")
    stream.start(stream.file_stream(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/cp", language="es", technical_out=f"{tmp_path}/tech").awaitTermination()
    table, rows = spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/tech")
    assert table.count() == rows.count() == 5 and sorted(r["segment_id"] for r in rows.collect()) == sorted(r["segment_id"] for r in table.collect())


def test_an_english_regulation_by_hand(spark):
    text = (
        "WHEREAS the users of the Long Ditch have shared its water since the first settlers dug it by hand along the old road.\n"
        "Chapter II: Members\nArticle 4. Every user shall pay the annual fee before the first of May. The clerk of the board shall keep the book of payments.\n"
        "Section 5 Duties\nEvery member of the association has the duties below:\n- a) to keep the ditch clean\n- b) to attend meetings\n\n"
        "1) Members who are absent from three meetings in a row without a reason lose their turn. The board decides whether a reason is good enough.\n"
        "Signed by the board of the Long Ditch"
    )
    docs = spark.createDataFrame([("d", "9. Ditch.md", text)], "doc_id string, source_base string, text string")
    from statutegrid.operators.blocks import blocks_of

    got = [(r["segment_type"], r["article"], r["parent_segment_id"], r["aim_trigger_candidate"]) for r in statutegrid.run(blocks_of(docs), "en")[0].orderBy("segment_order").collect()]
    assert got == [
        ("preamble", None, None, ""), ("heading", None, None, ""), ("heading", "4", None, ""), ("body_sentence", "4", None, "shall | pay"),
        ("body_sentence", "4", None, "shall | keep"), ("heading", "5", None, ""), ("list_header", "5", None, ""), ("list_item", "5", "seg_0007", "keep"),
        ("list_item", "5", "seg_0007", "attend"), ("body_sentence", "5", None, ""), ("body_sentence", "5", None, "decides"), ("signature", "5", None, ""),
    ]
