"""The seam for a parser: an installed analyzer's sentence boundaries and tokens in place of the rules.

An analyzer is any object with sentences(texts, language) -> a list of sentences for each text, and tokens(texts, languages) -> for each text its tokens
(text, lemma, pos, dep, start, head), head being the place of the token that it hangs from. What is an institutional verb is
then told from its dependencies, in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statutegrid.functions import lexicon as L
from statutegrid.functions import patterns as P
from statutegrid.functions.ship import ship
from statutegrid.functions.text import let

TOKENS = "array<struct<text:string,lemma:string,pos:string,dep:string,start:int,head:int>>"
#: Dependencies of verbs that carry a rule, and of auxiliaries.
MAIN, AUXILIARY = ("ROOT", "conj", "xcomp", "ccomp", "advcl"), ("aux", "auxpass")
SHORTEST = 3


def sentences_by(load: Callable[[], object], language: str) -> Callable[[Column], Column]:
    """Boundaries for `split_sentences` from an analyzer that each worker makes once."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyzer = load()
        for texts in batches:
            found = analyzer.sentences([t or "" for t in texts], language)
            yield pd.Series([[s.strip() for s in each if s.strip()] for each in found])

    return cut


def with_tokens(segments: DataFrame, load: Callable[[], object]) -> DataFrame:
    """segments (segment_text, language) with tokens."""

    @F.pandas_udf(T._parse_datatype_string(TOKENS))  # type: ignore[call-overload]
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        analyzer = load()
        names = ("text", "lemma", "pos", "dep", "start", "head")
        for texts, languages in batches:
            found = analyzer.tokens(list(texts), list(languages))
            yield pd.Series([[dict(zip(names, t, strict=True)) for t in each] for each in found])

    ship(segments.sparkSession)
    return segments.withColumn("tokens", read(F.col("segment_text"), F.col("language")))


def aims_of_tokens(tokens: Column, language: Column) -> Column:
    """Institutional verbs (verb, lemma, position, suggested_type), the first of each lemma.

    A modal auxiliary is one by itself; a verb in a main dependency is one if the lexicon has its lemma or a modal auxiliary hangs from it.
    """
    by = lambda en, es: F.when(language == "en", F.lit(en)).otherwise(F.lit(es))
    modal_lemmas, modal_forms = by(P.DEONTICS_EN, P.DEONTIC_LEMMAS_ES), by(P.DEONTICS_EN, P.DEONTICS_ES)

    def category(lemma: Column) -> Column:
        types = lambda lang: {x: c for c, lemmas in L.LEXICON[lang].items() for x in lemmas}
        return F.when(language == "en", L.mapped(lemma, types("en"))).otherwise(L.mapped(lemma, types("es")))

    def helped(all_: Column) -> Column:
        """Places that a modal auxiliary hangs from."""
        return F.transform(F.filter(all_, lambda t: t["dep"].isin(*AUXILIARY) & F.array_contains(modal_forms, F.lower(t["text"]))), lambda t: t["head"])

    def judged(all_: Column, heads: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            lemma = F.lower(t["lemma"])
            auxiliary = (t["pos"] == "AUX") & t["dep"].isin(*AUXILIARY)
            main = (t["pos"] == "VERB") & t["dep"].isin(*MAIN) & (F.length(lemma) >= SHORTEST) & lemma.rlike(r"^\p{L}")
            kind = category(lemma)
            wanted = F.when(auxiliary, F.array_contains(modal_lemmas, lemma)).otherwise(main & (kind.isNotNull() | F.array_contains(heads, i)))
            hit = F.struct(t["text"].alias("verb"), lemma.alias("lemma"), t["start"].alias("position"), F.when(~auxiliary, kind).alias("suggested_type"))
            return F.when(wanted, hit)

        return F.filter(F.transform(all_, one), lambda h: h.isNotNull())

    def once(hits: Column) -> Column:
        return let(F.transform(hits, lambda h: h["lemma"]), lambda lemmas: F.filter(hits, lambda h, i: F.array_position(lemmas, h["lemma"]) == i + 1))

    some = F.coalesce(tokens, F.array().cast(TOKENS))
    return let(some, lambda all_: let(let(helped(all_), lambda heads: judged(all_, heads)), once))
