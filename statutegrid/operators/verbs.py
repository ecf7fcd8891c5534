"""Institutional verbs of a text without a parser: lexicon forms, deontic auxiliaries and what follows them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import lexicon as L
from statutegrid.functions import patterns as P
from statutegrid.functions.text import let, without_accents

HIT = "array<struct<verb:string,lemma:string,position:int,suggested_type:string>>"
_TYPES = {lang: {lemma: c for c, lemmas in by.items() for lemma in lemmas} for lang, by in L.LEXICON.items()}


#: Parts of a text whose lengths are added up together: a part's place is that of its chunk and what comes before it there.
CHUNK = 256


def _listed(language: str) -> dict[str, str]:
    """Listed words: their own sign, a colon and the lemma that they are a form of, either of which may be missing; modal verbs are forms of none."""
    table = {w: sign for sign, listed in P.SIGNS[language].items() for w in listed.split()}
    forms, deontic = L.verb_forms(language), L.deontic_forms(language)
    return {w: f"{table.get(w, '')}:{'' if w in deontic else forms.get(w, '')}" for w in {**table, **forms}}


def _sign(word: Column, lower: Column, code: Column, language: str) -> Column:
    """A word's sign: its own, or what its shape and the lexicon say; code: what `_listed` says of it. What most words fail is asked first, of their ends."""
    end = lambda *ends: functools.reduce(operator.or_, [lower.endswith(e) for e in ends])
    manner = end(P.MANNER_END[language]) & lower.rlike(P.MANNER[language]) & ~lower.isin(*P.NO_MANNER[language])
    own, known = F.when(~code.startswith(":"), F.substring_index(code, ":", 1)), F.coalesce(~code.endswith(":"), F.lit(False))
    if language == "es":
        infinitive = F.substring(lower, -6, 6).rlike(P.INFINITIVE_ES) & lower.rlike(P.INFINITIVE_ES)
        shape = F.when(infinitive, "i").when(known, "v").when(lower.rlike(P.PARTICIPLE["es"]), "r").otherwise("w")
        return F.coalesce(own, F.when(manner, "n").otherwise(shape))
    base = lower.isin(*P.BASE_EN) | ~F.substring(lower, -4, 4).rlike(P.NO_BASE_EN)
    participle = lower.isin(*P.PARTICIPLES_EN) | (end("ed", "en") & lower.rlike(P.PARTICIPLE["en"]) & ~lower.isin(*P.NO_PARTICIPLE_EN))
    shape = F.when(known, "v").when(participle, "e").when(base, "w").otherwise("s")
    return F.when(word == "May", "M").otherwise(F.coalesce(own, F.when(manner, "n").otherwise(shape)))


def _gap(part: Column) -> Column:
    """The sign of what stands between two words; none of blanks and hyphens."""
    sign = F.lit("")
    for pattern, name in reversed(P.GAPS):
        sign = F.when(part.rlike(pattern), name).otherwise(sign)
    return sign


def claims(signs: Column, language: str) -> Column:
    """A text's signs, one a word, with V where a modal verb governs a word and N where a determiner makes one a noun.

    A cascade of finite-state passes: each is one regular expression over signs, so it runs through the text once, and a modal verb keeps its claim
    over negation, adverbs, phrases between commas and phrases that only the next determiner, preposition or end tells from the verb.
    """
    for pattern, into in P.CLAIMS[language]:
        signs = F.regexp_replace(signs, pattern, P.java_replacement(into))
    return signs


def _hits(text: Column, language: str, auxiliaries: bool = False, take: str = "all") -> Column:
    """Candidates in order: (verb, lemma, position, suggested_type), a lemma as often as it occurs. auxiliaries: they count too. take: "once", the first of each lemma; "first", the first alone.

    A form of the lexicon counts unless a determiner makes it a noun (a Spanish infinitive counts even so), a modal verb unless it is a noun or a month, and any word
    that a modal verb governs. So a text without a modal verb and without a form has none, and its words are only looked up.
    """
    deontic = L.deontic_forms(language)
    more = P.AUXILIARIES[language] if auxiliaries else []
    listed = _listed(language)

    def token(part: Column, i: Column) -> Column:
        def word(low: Column) -> Column:
            made = lambda code: F.struct(part.alias("t"), low.alias("w"), i.alias("i"), F.nullif(F.substring_index(code, ":", -1), F.lit("")).alias("known"), _sign(part, low, code, language).alias("sign"))
            return let(L.mapped(low, listed), made)

        gap = F.struct(part.alias("t"), F.lit("").alias("w"), i.alias("i"), F.lit(None).cast("string").alias("known"), _gap(part).alias("sign"))
        return F.when(part != " ", F.when(part.rlike(r"^\p{L}"), let(F.lower(part), word)).otherwise(gap))

    def marked(tokens: Column) -> Column:
        signs = F.split(claims(F.array_join(F.transform(tokens, lambda x: x["sign"]), ""), language), "")
        put = lambda marks: F.transform(tokens, lambda x, n: F.struct(x["t"], x["w"], x["i"], x["known"], F.get(marks, n).alias("mark")))
        return F.filter(let(signs, put), lambda x: x["mark"].isin(*P.MODAL_SIGNS[language], "V") | (x["known"].isNotNull() & (x["mark"] != "N")) | x["w"].isin(more))

    def named(x: Column) -> Column:
        modal = x["mark"].isin(*P.MODAL_SIGNS[language])
        lemma = F.when(modal, L.mapped(x["w"], deontic)).otherwise(F.coalesce(x["known"], F.regexp_replace(x["w"], P.CLITIC_END, "") if language == "es" else x["w"]))
        return F.struct(x["t"].alias("verb"), lemma.alias("lemma"), x["i"].alias("i"), modal.alias("modal"))

    def once(hits: Column) -> Column:
        lemmas = F.transform(hits, lambda h: h["lemma"])
        return let(lemmas, lambda all_: F.transform(F.array_distinct(all_), lambda x: F.get(hits, F.array_position(all_, x).cast("int") - 1)))

    def hit(x: Column, parts: Column, places: Column) -> Column:
        chunk = F.floor(x["i"] / CHUNK).cast("int")
        at = F.get(places, chunk) + F.length(F.array_join(F.slice(parts, chunk * CHUNK + 1, x["i"] - chunk * CHUNK), ""))
        return F.struct(x["verb"], x["lemma"], at.cast("int").alias("position"), F.when(~x["modal"], L.mapped(x["lemma"], _TYPES[language])).alias("suggested_type"))

    def found(parts: Column) -> Column:
        tokens = F.filter(F.transform(parts, token), lambda x: x["sign"] != "")
        hits = let(tokens, marked)
        # places are dear: only those of the hits that are taken are looked for
        chosen = F.transform(F.slice(hits, F.lit(1), F.lit(1)) if take == "first" else hits, named)
        chosen = let(chosen, once) if take == "once" else chosen
        placed = lambda all_: F.when(F.size(all_) > 0, let(_chunk_places(parts), lambda places: F.transform(all_, lambda x: hit(x, parts, places)))).otherwise(F.array().cast(HIT))
        return let(chosen, placed)

    boundaries = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"
    verbs = {*L.verb_forms(language), *deontic, *more, *(w for sign in P.MODAL_SIGNS[language] for w in P.SIGNS[language][sign].split())}
    may_hold = F.exists(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*sorted(verbs)))
    return F.when(may_hold, let(F.split(text, boundaries), found)).otherwise(F.array().cast(HIT))


def _chunk_places(parts: Column) -> Column:
    """Where each chunk of parts begins in the text."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
    sizes = F.transform(chunks, lambda c: F.length(F.array_join(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)), "")))
    return let(sizes, lambda all_: F.transform(all_, lambda _, n: F.aggregate(F.slice(all_, F.lit(1), n), F.lit(0), lambda a, b: a + b)))


def extract_aims(text: Column, language: Column) -> Column:
    """Verb hits of a text, the first of each lemma; empty for blank texts. Languages other than en are read as es."""
    text = F.coalesce(text, F.lit(""))
    return F.when(language == "en", _hits(text, "en", take="once")).otherwise(_hits(text, "es", take="once"))


def first_aim(text: Column, language: Column) -> Column:
    """The first of `extract_aims`; null where there is none."""
    text = F.coalesce(text, F.lit(""))
    return F.get(F.when(language == "en", _hits(text, "en", take="first")).otherwise(_hits(text, "es", take="first")), F.lit(0))


def first_verb(text: Column, language: Column) -> Column:
    """struct(verb, lemma) of the first verb that is a modal, in the lexicon, governed by a modal or an auxiliary; empty strings without one."""
    text = F.coalesce(text, F.lit(""))
    found = F.get(F.when(language == "en", _hits(text, "en", True, "first")).otherwise(_hits(text, "es", True, "first")), F.lit(0))
    return let(found, lambda hit: F.struct(F.coalesce(hit["verb"], F.lit("")).alias("verb"), F.coalesce(hit["lemma"], F.lit("")).alias("lemma")))


def has_deontic(text: Column, language: Column, folded: bool = False) -> Column:
    """Whether a deontic pattern occurs; Spanish stems stand without accents, so "deberá" is none unless the text is folded."""
    text = F.coalesce(text, F.lit(""))
    spanish = without_accents(text) if folded else text
    return F.when(language == "en", text.rlike(P.java(P.DEONTIC_RE_EN))).otherwise(spanish.rlike(P.java(P.DEONTIC_RE_ES)))


def verb_features(text: Column, language: Column, folded: bool = False) -> Column:
    """struct of counts, flags, distinct lemmas and categories, with both lists also joined by semicolons. folded: see `has_deontic`."""
    return let(extract_aims(text, language), lambda aims: _features(aims, text, language, folded))


def _features(aims: Column, text: Column, language: Column, folded: bool) -> Column:
    lemmas = F.transform(aims, lambda a: a["lemma"])
    types = F.array_distinct(F.filter(F.transform(aims, lambda a: a["suggested_type"]), lambda c: c.isNotNull()))
    return F.struct(
        F.size(lemmas).alias("n_institutional_verbs"), (F.size(lemmas) > 0).alias("has_institutional_verb"), lemmas.alias("verb_lemmas"),
        types.alias("verb_categories"), has_deontic(text, language, folded).alias("has_deontic_aux"),
        F.array_join(lemmas, ";").alias("verb_lemmas_text"), F.array_join(types, ";").alias("verb_categories_text"),
    )


def lexicon_prefixes(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """texts (key, language, text) as (key, category_no, category, lemma): lemmas that a word of the text begins with.

    Words join the lexicon on their first letters, as many as its shortest lemma has, so this is an equi-join with a small, fixed table, not a nested loop.
    """
    lex = L.frame(texts.sparkSession)
    letters = min(3, *(len(lemma) for by in L.LEXICON.values() for lemmas in by.values() for lemma in lemmas))
    heads = lex.withColumn("_head", F.substring("lemma", 1, letters)).withColumnRenamed("language", "_language")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?U)[\w]+"), F.lit(0)))
    spread = texts.select(key, "language", F.explode(words).alias("_word")).withColumn("_head", F.substring("_word", 1, letters))
    joined = spread.join(F.broadcast(heads), ["_head"]).where((F.col("language") == F.col("_language")) & F.startswith("_word", "lemma"))
    return joined.select(key, "category_no", "category", "lemma").distinct()


def with_fallback(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """texts (key, language, text) with features: `verb_features`, and where those find no verb, the lexicon's lemmas that words begin with.

    Each row by itself and each text once: no join, so the verbs are not searched for again on its other side.
    """
    text, language = F.col("text"), F.col("language")
    return texts.withColumn("features", let(verb_features(text, language), lambda found: F.when(found["has_institutional_verb"], found).otherwise(_other_features(found, text, language))))


def _other_features(found: Column, text: Column, language: Column) -> Column:
    """Features by `prefix_hits`; those found where there are none."""

    def put(hits: Column) -> Column:
        lemmas, categories = F.array_distinct(F.transform(hits, lambda x: x["lemma"])), F.array_distinct(F.transform(hits, lambda x: x["category"]))
        made = F.struct(
            F.size(lemmas).alias("n_institutional_verbs"), F.lit(True).alias("has_institutional_verb"), lemmas.alias("verb_lemmas"), categories.alias("verb_categories"),
            found["has_deontic_aux"].alias("has_deontic_aux"), F.array_join(lemmas, ";").alias("verb_lemmas_text"), F.array_join(categories, ";").alias("verb_categories_text"),
        )
        return F.when(F.size(hits) > 0, made).otherwise(found)

    return let(prefix_hits(text, language), put)


def prefix_hits(text: Column, language: Column) -> Column:
    """(category, lemma) of the lexicon's entries that words of a text begin with: categories in lexicon order, longer lemmas first in each; none for other languages.

    One pattern finds the longest lemma at the start of each word; shorter ones that a word begins with are beginnings of that one.
    """
    out = F.array().cast("array<struct<category:string,lemma:string>>")
    for lang, by in L.LEXICON.items():
        entries = [(c, lemma) for c, lemmas in by.items() for lemma in sorted(set(lemmas), key=lambda x: (-len(x), x))]
        longest = sorted({lemma for _, lemma in entries}, key=lambda x: (-len(x), x))
        heads = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(?<!\w)(?:" + "|".join(longest) + ")"), F.lit(0)))
        listed = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(lemma).alias("lemma")) for c, lemma in entries])
        out = F.when(language == lang, let(heads, lambda hs: F.filter(listed, lambda e: F.exists(hs, lambda h: h.startswith(e["lemma"]))))).otherwise(out)
    return out


def lexicon_fallback(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lemmas, categories): categories in lexicon order, longer lemmas first in each; over all rows of a key."""
    hit = F.struct("category_no", (-F.length("lemma")).alias("n"), "lemma", "category")
    found = lexicon_prefixes(texts, key).groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("h"))
    return found.select(key, F.array_distinct(F.transform("h", lambda x: x["lemma"])).alias("lemmas"), F.array_distinct(F.transform("h", lambda x: x["category"])).alias("categories"))
