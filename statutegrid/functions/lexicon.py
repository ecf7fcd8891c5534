"""A small lexicon of institutional verbs, by category, and the forms that they take in texts.

The categories are rule types of the Institutional Grammar. Lemmas are this project's own choice; forms follow from regular
endings, so the dimension grows by rule.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P

LEXICON: dict[str, dict[str, tuple[str, ...]]] = {
    "es": {
        "POS": ("elegir", "nombrar", "designar", "integrar"),
        "BOU": ("ingresar", "salir", "admitir", "renunciar", "expulsar"),
        "CHO": ("usar", "mantener", "cumplir", "respetar", "presentar", "asistir", "realizar", "utilizar"),
        "AGG": ("aprobar", "acordar", "votar", "decidir", "convocar"),
        "INF": ("informar", "comunicar", "notificar", "publicar", "registrar"),
        "PAY": ("sancionar", "pagar", "multar", "cobrar", "indemnizar"),
        "SCO": ("definir", "delimitar", "alcanzar"),
    },
    "en": {
        "POS": ("elect", "appoint", "designate", "nominate"),
        "BOU": ("enter", "admit", "join", "resign", "expel"),
        "CHO": ("use", "maintain", "comply", "respect", "attend", "keep", "submit", "perform"),
        "AGG": ("approve", "agree", "vote", "decide", "convene"),
        "INF": ("inform", "notify", "report", "publish", "register", "record"),
        "PAY": ("sanction", "pay", "fine", "charge", "compensate"),
        "SCO": ("define", "limit", "achieve"),
    },
}
_ENDINGS_ES = {"ar": "ar a an ará arán ado ada ando e en", "er": "er e en erá erán ido ida iendo a an", "ir": "ir e en irá irán ido ida iendo a an"}
_IRREGULAR = {
    "es": {"mantener": "mantiene mantienen mantendrá mantendrán", "salir": "sale salen saldrá saldrán", "elegir": "elige eligen", "aprobar": "aprueba aprueban", "acordar": "acuerda acuerdan"},
    "en": {"pay": "paid", "keep": "kept", "comply": "complies complied", "notify": "notifies notified", "expel": "expelled expelling", "admit": "admitted admitting", "submit": "submitted submitting"},
}
_DEONTIC_FORMS = {
    "es": {
        "deber": "debe deben deberá deberán", "poder": "puede pueden podrá podrán", "tener": "tendrá tendrán", "haber": "habrá habrán",
        "corresponder": "corresponde corresponden corresponderá",
    },
    "en": {w: w for w in P.DEONTICS_EN},
}


def lookup_verb_type(lemma: str, language: str) -> str | None:
    return next((c for c, lemmas in LEXICON.get(language, {}).items() if lemma.lower() in lemmas), None)


#: Spanish order without accents: é is e, ñ is not n.
FOLDED = "es_AI"


@cache
def verb_forms(language: str) -> dict[str, str]:
    """Form to lemma; the lemma that comes first keeps a form."""
    out: dict[str, str] = {}
    for lemmas in LEXICON[language].values():
        for lemma in lemmas:
            if language == "es":
                forms = [lemma[:-2] + e for e in _ENDINGS_ES[lemma[-2:]].split()]
            else:
                stem = lemma.removesuffix("e")
                forms = [lemma, lemma + "s", stem + "ed", stem + "ing", lemma + "es"]
            for form in [lemma, *forms, *_IRREGULAR[language].get(lemma, "").split()]:
                out.setdefault(form, lemma)
    return out


@cache
def deontic_forms(language: str) -> dict[str, str]:
    return {form: lemma for lemma, forms in _DEONTIC_FORMS[language].items() for form in forms.split()}


def frame(spark: SparkSession) -> DataFrame:
    """The lexicon as a dimension: language, category_no, category, lemma. Its size is fixed, so it may be broadcast."""
    rows = [(lang, n, c, lemma) for lang, by in LEXICON.items() for n, (c, lemmas) in enumerate(by.items()) for lemma in lemmas]
    return spark.createDataFrame(rows, "language string, category_no int, category string, lemma string")


def lookup(df: DataFrame, language: str = "language", lemma: str = "lemma", folded: bool = False) -> DataFrame:
    """Left equi-join to the lexicon: df with category, null for unknown lemmas. folded: accents do not count, by a collation in which ñ stays a letter."""
    lex = frame(df.sparkSession).select(F.col("language").alias("_language"), F.col("lemma").alias("_lemma"), "category")
    on = (F.col(language) == F.col("_language")) & (F.collate(F.lower(lemma), FOLDED) == F.collate("_lemma", FOLDED) if folded else F.lower(lemma) == F.col("_lemma"))
    return df.join(F.broadcast(lex), on, "left").drop("_language", "_lemma")


#: Parts of a lookup table: a map is searched key by key, so the key's checksum picks one of so many small maps.
PARTS = 256


def mapped(key: Column, table: dict[str, str]) -> Column:
    """A lookup in a fixed table, null for unknown keys."""
    parts: list[dict[str, str]] = [{} for _ in range(PARTS)]
    for k, v in table.items():
        parts[zlib.crc32(k.encode()) % PARTS][k] = v
    # one literal, worked out while the query is planned
    maps = F.from_json(F.lit(json.dumps(parts, ensure_ascii=False)), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % F.lit(PARTS).cast("long")).cast("int")), key)
