"""Sentence ends learnt from the texts themselves, held against texts whose sentences are marked by construction."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import statutegrid
from statutegrid.operators import boundaries as B

ES = [
    "El Sr. Presidente convoca la asamblea", "La Dña. Carmen Ruiz y el Excmo. Alcalde firman el acta", "El art. 5 y el art. 12 siguen en vigor", "Véase la pág. 14 del núm. 3", "Se riega aprox. tres horas por turno", "El Sr. García preside la comisión",
    "La sede está en la avda. Mayor", "Los socios pagan la cuota", "La junta decide por mayoría", "El tesorero lleva las cuentas", "Nadie vende el agua", "El presidente de la comunidad vota", "La multa es de diez euros", "Los turnos los fija el sr. vocal", "El secretario lee el núm. 8 del diario",
]
EN = [
    "The Hon. Chair opens the meeting", "See sec. 4 and sec. 9 of the rules", "Each user takes approx. two hours", "The dept. keeps the map", "J. R. Smith signs the book", "Members pay the fee", "No one sells water", "The board decides by vote",
    "The clerk reads the list", "The chair of the board votes", "Every gate has a lock", "Tools, nets, etc. belong to all", "The corp. Council meets here",
]


def marked(sentences, n, seed):
    """(id, text, sentences)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        found = [rng.choice(sentences) + rng.choice([".", ".", ".", "!", "?"]) for _ in range(rng.randrange(1, 12))]
        out.append((i, rng.choice([" ", "  ", "\n"]).join(found), found))
    return out


@pytest.mark.parametrize("sentences, words", [(ES, {"sr", "dña", "excmo", "art", "pág", "núm", "aprox", "avda"}), (EN, {"hon", "sec", "approx", "dept", "corp", "etc"})])
def test_marked_texts_need_no_list(spark, sentences, words):
    rows = marked(sentences, 300, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "id int, text string").repartition(4)
    counts = B.word_counts(docs)
    assert {r["word"] for r in B.abbreviations(counts).collect()} >= words
    pairs = B.going_on(docs, counts)
    cut = B.learnt_sentences(pairs)
    got = {r["id"]: r["s"] for r in docs.select("id", cut(F.col("text")).alias("s")).collect()}
    right = sum(len([x for x in got[i] if x in want]) for i, _, want in rows)
    precision, recall = right / sum(map(len, got.values())), right / sum(len(want) for *_, want in rows)
    assert precision >= 0.97 and recall >= 0.97, (precision, recall)
    # cut by a join, where pairs are too many for the plan, sentences are the same
    assert {r["id"]: r["raw"] for r in B.with_sentences(docs, pairs, "id").collect()} == got


def test_scores_are_those_of_a_plain_count(spark):
    rows = marked(EN, 80, 2)
    texts = [t for _, t, _ in rows]
    n, pointed = Counter(), Counter()
    for t in texts:
        for token in t.split():
            word = token.lower().strip(",").rstrip("!?")
            pointed[word.removesuffix(".")] += word.endswith(".")
            n[word.removesuffix(".")] += 1
    p = sum(pointed.values()) / sum(n.values())
    want = {}
    for w in n:
        if not pointed[w] or not w[0].isalpha():
            continue
        rest = n[w] - pointed[w]
        fits = lambda q: pointed[w] * math.log(q) + rest * math.log(1 - q)
        value = 2 * (fits(0.99) - fits(p)) * math.exp(-len(w)) * len(w) ** -rest
        if value >= B.LEAST_SCORE:
            want[w] = pytest.approx(value)
    got = B.abbreviations(B.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert {r["word"]: r["score"] for r in got} == want


def test_a_list_is_a_prior_only(spark):
    docs = spark.createDataFrame([("The Messrs. Miller own it. The board knows.",)], "text string")
    counts = B.word_counts(docs)
    assert B.going_on(docs, counts).count() == 0
    assert [r["pair"] for r in B.going_on(docs, counts, prior=["Messrs"]).collect()] == ["Messrs Miller"]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "..."), (5, ". . ."), (6, "No end"), (7, "End. "), (8, "a.b.c. d"), (9, "ok." * 3000 + " Yes. No.")], "id int, text string")
    pairs = B.going_on(docs, B.word_counts(docs))
    got = {r["id"]: r["raw"] for r in B.with_sentences(docs, pairs, "id").collect()}
    assert got[1] == got[2] == got[3] == [] and got[6] == ["No end"] and got[7] == ["End."] and got[9][-2:] == ["Yes.", "No."]
    none = docs.limit(0)
    assert B.with_sentences(none, B.going_on(none, B.word_counts(none)), "id").count() == 0


def test_the_whole_way_takes_learnt_ends(spark):
    text = "El regl. Interno fija las cuotas de los socios cada año. La junta de socios lo aprueba en la asamblea."
    blocks = spark.createDataFrame([("d", "1. x.md", 0, None, text)], "doc_id string, source_base string, block_no int, page int, text string")
    more = spark.createDataFrame([(f"El regl. Interno fija el turno {n}. Lo dice el regl. Interno aquí.",) for n in range(30)], "text string")
    cut = B.learnt_sentences(B.going_on(more, B.word_counts(more)))
    learnt = [r["segment_text"] for r in statutegrid.run(blocks, "es", boundaries=cut)[0].orderBy("segment_order").collect()]
    listed = [r["segment_text"] for r in statutegrid.run(blocks, "es")[0].orderBy("segment_order").collect()]
    assert learnt == ["El regl. Interno fija las cuotas de los socios cada año.", "La junta de socios lo aprueba en la asamblea."]
    assert listed[0] == "El regl."


def test_texts_are_gone_through_once_and_patterns_once_a_spelling(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(n, t) for n, t, _ in marked(ES, 60, 4)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3).mapInArrow(through, "id int, text string")
    B.abbreviations(B.word_counts(docs)).write.parquet(f"{tmp_path}/out")
    assert seen.value == len(rows)
    plan = B.word_counts(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = next(n for n, line in enumerate(plan) if "Aggregate [t#" in line) + 1
    assert not any("regexp_extract" in line for line in plan[below:])


def test_no_words_no_abbreviations(spark):
    assert B.abbreviations(B.word_counts(spark.createDataFrame([(None,), ("",), (" \n",)], "text string"))).count() == 0
