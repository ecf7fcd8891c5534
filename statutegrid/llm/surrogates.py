"""Operator 8, surrogate generation for personal data [native].

Detectors, one pattern a kind, find entities in whole texts; cards must also have an issuer's prefix and a right check digit, IBANs their
country's length and check digits. What an entity is called by (`norm`) is its type's canonical form, so spellings of one entity agree
everywhere. Its surrogate is derived from a secret key, its type and that form: letters for letters of the same script and case, digits for
digits, right check digits for cards and IBANs, names of the same gender and script; the spelling that the text uses is laid over it.

Persons are found by a title. Titles of either gender take the gender that the document gives the name elsewhere, else the one that most texts give it, else names of their
own. A name that a title has shown is replaced wherever it stands in the same document as a word of the same case or in capitals, with or without a title.

Distinctness is checked over all entities of all documents: where two would get one surrogate, or one would get another's real
form, all but the smallest draw again with a higher attempt, until none is left; a kind whose forms are too few for that gets longer ones.
First draws are computed in place, so that only documents with such an entity take part in a join.

A text is read twice: once for the entities in it, once to write it anew. Each reading is one replacement that marks entities by
kind and one split at the marks; a cheap gate passes over texts without digits, at signs, titles and secret words.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.text import let
from statutegrid.llm.common import bounded, column, cut, table

#: The session's setting that holds the secret key; and the key of the query, which is public and so protects nobody.
KEY_SETTING = "spark.statutegrid.surrogates.key"
QUERY_KEY = "statutegrid-surrogates-1"
#: Draws in a kind's own format; later ones are longer by one character more each.
ATTEMPTS = 12

# ---- fixed values: titles, secret words, issuers' prefixes, lengths of IBANs by country ---------
_MALE = "Mr|Mister|Sir|Herr|Señor|Sr|Don|Monsieur|Господин|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Lady|Frau|Fräulein|Señora|Señorita|Sra|Srta|Doña|Dra|Doctora|Profesora|Madame|Mme|Mademoiselle|Mlle|Госпожа|Κυρία"
_EITHER = "Dr|Doctor|Doktor|Docteur|Prof|Professor|Profesor|Доктор|Профессор|Δρ"
_SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
_ISSUER = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-8]|30[0-5]|6(?:011|4[4-9]|5|2))"
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
    32: "LC", 33: "RU",
}
# -------------------------------------------------------------------------------------------------

_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_EITHER})\.?"
_INITIALS = "".join(sorted({t[0] for t in f"{_MALE}|{_FEMALE}|{_EITHER}".split("|")}))
#: A capital and more of a word; parts behind a hyphen or an apostrophe begin with capitals too, so a genitive's end is no part.
_NAME = r"(?=[\p{L}\p{M}’'-]{2})\p{Lu}[\p{L}\p{M}]*(?:[’'-]\p{Lu}[\p{L}\p{M}]*)*"


def _iban_pattern() -> str:
    def of(length: int, countries: str) -> str:
        whole, rest = divmod(length - 4, 4)
        return rf"(?:{'|'.join(countries.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")

    return r"(?=[A-Z]{2}\d{2})\b(?:" + "|".join(of(*x) for x in _IBAN_LENGTHS.items()) + r")(?![\p{L}\p{N}])"


#: In order: an alternative that stands earlier wins where two begin at one place. Each begins with what can be told from one or a few characters.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": rf"(?=[aApPsStT])(?i:\b(?:{_SECRET_WORDS})\b\s{{0,3}}[=:]\s{{0,3}}[\"']?)[A-Za-z0-9_/+-]{{16,}}[\"']?",
    "iban": _iban_pattern(),
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?=[+(\d])(?:\+1[^\p{L}\p{N}\n]{1,8}\d{3}[^\p{L}\p{N}\n]{1,8}\d{3}[^\p{L}\p{N}\n]{1,8}\d{4}(?!\d)"
    r"|\+(?!1\D)\d{1,3}[ .()-]{1,3}\d{2,4}(?:[ .()-]{1,3}\d{2,4}){1,4}(?!\d|\.\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d))",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "person": rf"(?=[{_INITIALS}])(?<!\p{{L}}){_TITLE}(?: {_TITLE})* {_NAME}(?: {_NAME}){{0,2}}",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"({p})" for p in PATTERNS.values())
#: What persons and secrets begin with; secrets only have to be looked for where their mark is.
_PERSON_GATE = rf"(?=[{_INITIALS}]){_TITLE} \p{{Lu}}"
_SECRET_GATE = rf"(?i:{_SECRET_WORDS})\s{{0,3}}[=:]"
#: Marks around what was found: a noncharacter and a second one that tells what it means; the first one in a text itself is escaped.
_MARK = "\ufdd0"
_ESCAPED, _OPEN, _NEXT, _CLOSE = (_MARK + c for c in "\ufdd1\ufdd2\ufdd3\ufdd4")

#: Fixed parts that surrogate names are put together from, by script.
_ONSETS = {
    "latin": "Bal Cor Dan Elm Fer Gal Hol Ing Jor Kel Lan Mar Nor Orl Pel Ram Sal Tor Ulm Val",
    "cyrillic": "Бал Вор Дан Ель Фер Гал Хол Инг Жор Кел Лан Мар Нор Орл Пел Рам Сал Тор Ульм Вал",
    "greek": "Βαλ Γαλ Δαν Ελμ Φερ Ζαν Θολ Ινγ Καρ Κελ Λαν Μαρ Νορ Ορλ Πελ Ραμ Σαλ Τορ Χαλ Ψαρ",
}
_MIDDLES = {
    "latin": "a e i o u ar en il om un ad el is or ul av es in ot ur", "cyrillic": "а е и о у ар ен ил ом ун ад ел ис ор ул ав ес ин от ур",
    "greek": "α ε ι ο υ αρ εν ιλ ομ υν αδ ελ ισ ορ υλ αβ εσ ιν οτ υρ",
}
_ENDS = {
    ("latin", "given_m"): "do ric mund bert win las ton fred", ("latin", "given_f"): "da lia na rina bella line ssa thea",
    ("latin", "given_n"): "ley ren ray kim sky ble vian lor", ("latin", "surname"): "berg ford stad mont vale field quist garde",
    ("cyrillic", "given_m"): "мир слав лан тон дор рик дан мар", ("cyrillic", "given_f"): "на лия рина мира дора тея сия рада",
    ("cyrillic", "given_n"): "ли рен рей ким скай бле ви лор", ("cyrillic", "surname"): "ко чук ский ман дзе вец як нюк",
    ("greek", "given_m"): "δωρος κλης μος νωρ φων στος λαος ριος", ("greek", "given_f"): "νη λια ρινα δωρα θεα μελη σια ρω",
    ("greek", "given_n"): "λευ ρεν ραι κιμ σκαι βλε βι λορ", ("greek", "surname"): "ιδης ακης οπουλος ογλου ατος ελλης εας ινος",
}
_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_RANGES = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

_own_key: list[str] = []


def secret_key(spark: SparkSession, key: str | None = None) -> str:
    """The given key, else the session's; a session on a single machine that names none draws one that ends with the process."""
    if not key and not spark.conf.get(KEY_SETTING, "") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"give a key or set {KEY_SETTING}: surrogates must not follow from a known one")
    return key or run_key(spark)


def run_key(spark: SparkSession) -> str:
    """The session's key, else one drawn at random for this driver process, on any cluster: the key is a literal of the plans, so all executors work with the driver's.

    For runs whose surrogates need to agree with those of no other run.
    """
    if found := spark.conf.get(KEY_SETTING, ""):
        return found
    if not _own_key:
        _own_key.append(secrets.token_hex(32))
    return _own_key[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _seed(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string")), 256)


def _draw(seed: Column, place: Column | int, of: int) -> Column:
    """A number below `of` for a place in the stream of a seed."""
    return F.pmod(F.xxhash64(seed, place if isinstance(place, Column) else F.lit(place)), F.lit(of)).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def _letters(text: Column, seed: Column, alphabet: str | None = None) -> Column:
    """Lower-case text with each letter and digit redrawn within its script; other characters, and letters of other scripts, stay marks or become Latin letters."""
    def one(c: Column, i: Column) -> Column:
        latin = _pick(alphabet or _LOWER["latin"], _draw(seed, i, len(alphabet or _LOWER["latin"])))
        digit = _pick(alphabet or "0123456789", _draw(seed, i, len(alphabet or "0123456789")))
        out = F.when(c.rlike(r"^[0-9]$"), digit)
        for script, range_ in _RANGES.items():
            out = out.when(c.rlike(f"^{range_}$"), _pick(_LOWER[script], _draw(seed, i, len(_LOWER[script]))))
        return out.when(c.rlike(r"^\p{L}$"), latin).when(c.rlike(r"^\p{N}$"), digit).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of digits; the last one counts once."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.cast("int"), F.lit(0)) * (F.pmod(i, F.lit(2)) + 1))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def is_card(surface: Column) -> Column:
    d = _digits(surface)
    return F.length(d).between(13, 19) & d.rlike(_ISSUER) & (_luhn_sum(d) % 10 == 0)


def _mod_97(text: Column) -> Column:
    """Remainder of upper-case letters and digits read as one number, A as 10 and so on."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def is_iban(surface: Column) -> Column:
    return let(F.replace(surface, F.lit(" "), F.lit("")), lambda x: _mod_97(F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4))) == 1)


def _script(word: Column) -> Column:
    out = F.when(F.lit(False), "")
    for script, range_ in _RANGES.items():
        out = out.when(word.rlike(range_), script)
    return out.otherwise("latin")


def core(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity, a function of key, type, canonical form and attempt alone."""
    return let(_seed(key, kind, norm, attempt), lambda seed: _core(kind, norm, attempt, seed))


def _core(kind: Column, norm: Column, attempt: Column, seed: Column) -> Column:
    spread = lambda text: F.array_join(F.transform(F.split(text, ""), lambda c, i: _draw(seed, i, 10).cast("string")), "")
    # one more character for each try beyond ATTEMPTS: a dense kind's forms get longer
    longer = F.repeat(F.lit("0"), F.greatest(attempt - ATTEMPTS, F.lit(0)))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    labels = F.slice(F.split(domain, r"\."), F.lit(1), F.size(F.split(domain, r"\.")) - 1)
    # repeated tries lengthen what short forms leave too little room for
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.when(attempt > 0, _pick(_LOWER["latin"], _draw(seed, i + 900, 26))).otherwise("")), "")
    email = F.concat(_letters(local, seed), more, F.lit("@"), _letters(F.array_join(labels, "."), F.sha2(seed, 256)), F.lit(".example"))
    issuer = F.regexp_extract(norm, _ISSUER, 0)
    body = F.concat(issuer, spread(F.concat(F.substr(norm, F.length(issuer) + 2), longer)))
    card = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    octet = lambda i: _draw(seed, i, 256).cast("string")
    ip = F.concat_ws(".", F.when(attempt < 3, F.lit("10")).otherwise((_draw(seed, 0, 223) + 1).cast("string")), octet(1), octet(2), octet(3))
    ip = F.concat(ip, F.when(attempt > ATTEMPTS, F.concat(F.lit("."), spread(longer))).otherwise(""))
    country = F.regexp_extract(norm, r"^(\+\d{1,3}) ", 1)
    rest = _digits(F.regexp_replace(norm, r"^\+\d{1,3} ", ""))
    phone = F.concat(country, F.when(country != "", " ").otherwise(""), spread(F.concat(rest, longer)))
    hex_ = F.when(norm.rlike("^[0-9a-f]+$"), _letters(F.concat(norm, longer), seed, "0123456789abcdef")).otherwise(_letters(F.concat(norm, longer), seed))
    nation = F.substring(norm, 1, 2)
    account = _letters(F.concat(F.substr(norm, F.lit(5)), longer), seed)
    iban = let(account, lambda x: F.concat(nation, F.lpad((98 - _mod_97(F.upper(F.concat(x, nation, F.lit("00"))))).cast("string"), 2, "0"), x))

    def name(part: str) -> Column:
        def made(script: str) -> Column:
            def from_list(words: str, place: Column | int) -> Column:
                return F.element_at(F.split(F.lit(words), " "), _draw(seed, place, len(words.split())) + 1)

            middles = F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: from_list(_MIDDLES[script], i + 10))
            return F.concat(from_list(_ONSETS[script], 0), F.array_join(middles, ""), from_list(_ENDS[script, part], 1))

        of = F.when(F.lit(False), "")
        for script in _RANGES:
            of = of.when(_script(norm) == script, made(script))
        return F.lower(of.otherwise(made("latin")))

    out = (
        F.when(kind == "email", email).when(kind == "secret", hex_).when(kind == "iban", iban).when(kind == "ip", ip)
        .when(kind == "phone", phone).when(kind == "ssn", spread(F.concat(norm, longer))).when(kind == "card", card)
    )
    for part in ("given_m", "given_f", "given_n", "surname"):
        out = out.when(kind == part, name(part))
    return out


_SECRET_PARTS = r"^(.*?[=:]\s{0,3}[\"']?)([A-Za-z0-9_/+-]{16,})([\"']?)$"
_TITLES = rf"^({_TITLE}(?: {_TITLE})*) "
_MENTION = "array<struct<kind:string,norm:string,word:string>>"


def mentions(kind: Column, surface: Column) -> Column:
    """Entities that a found text names: one, or a person's names with the words that stand for them; the last is the surname."""
    one = lambda k, norm: F.array(F.struct(F.lit(k).alias("kind"), norm.alias("norm"), F.lit(None).cast("string").alias("word")))
    titles = F.regexp_extract(surface, _TITLES, 1)
    given = F.when(titles.rlike(rf"(?<!\p{{L}})(?:{_FEMALE})(?!\p{{L}})"), "given_f").when(titles.rlike(rf"(?<!\p{{L}})(?:{_MALE})(?!\p{{L}})"), "given_m").otherwise("given_n")
    person = let(F.split(F.regexp_replace(surface, _TITLES, ""), " "), lambda names: let(given, lambda g: F.transform(
        names, lambda w, i: F.struct(F.when(i == F.size(names) - 1, "surname").otherwise(g).alias("kind"), F.lower(w).alias("norm"), w.alias("word")),
    )))
    country = F.regexp_extract(surface, r"^(\+\d{1,3})", 1)
    national = _digits(F.regexp_replace(surface, r"^\+\d{1,3}", ""))
    # forms without a country are those of country 1
    phone = F.concat(F.when(country != "", country).otherwise("+1"), F.lit(" "), national)
    return (
        F.when(kind == "email", one("email", F.lower(surface))).when(kind == "secret", one("secret", F.lower(F.regexp_extract(surface, r"(?s)" + _SECRET_PARTS, 2))))
        .when(kind == "iban", one("iban", F.lower(F.replace(surface, F.lit(" "), F.lit(""))))).when(kind == "ip", one("ip", surface))
        .when(kind == "phone", one("phone", phone)).when(kind == "ssn", one("ssn", _digits(surface))).when(kind == "card", one("card", _digits(surface)))
        .when(kind == "person", person).otherwise(F.array().cast(_MENTION))
    )


def _lay(surface: Column, drawn: Column, mark: str) -> Column:
    """The characters of a canonical surrogate in the places and the case of the surface's; marks between them stay, further characters follow."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        new = F.substring(drawn, a["at"], F.lit(1))
        new = F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)
        use = c.rlike(mark)
        return F.struct(F.concat(a["out"], F.when(use, new).otherwise(c)).alias("out"), (a["at"] + F.when(use, 1).otherwise(0)).alias("at"))

    return let(F.aggregate(F.split(surface, ""), start, step), lambda x: F.concat(x["out"], F.substr(drawn, x["at"])))


def _cased(word: Column, drawn: Column) -> Column:
    """A drawn word in the surface's case: all capitals, first capital, or as it is."""
    capitals = (F.upper(word) == word) & (F.length(word) > 1)
    first = F.concat(F.upper(F.substring(drawn, 1, 1)), F.substr(drawn, F.lit(2)))
    return F.when(capitals, F.upper(drawn)).when(word.rlike(r"^\p{Lu}"), first).otherwise(drawn)


def _same_case(surface: Column, drawn: Column) -> Column:
    """A drawn text with capitals in the places of the surface's; behind its end in lower case."""
    letters = F.split(surface, "")
    return F.array_join(F.transform(F.split(drawn, ""), lambda c, i: F.when(F.coalesce(F.get(letters, i).rlike(r"^\p{Lu}$"), F.lit(False)), F.upper(c)).otherwise(c)), "")


def written(kind: Column, surface: Column, cores: Column) -> Column:
    """How the surrogate stands in the text; what is no entity stays as it is."""
    drawn = cores[0]
    at = lambda x, n: F.substring_index(x, "@", n)
    capitals = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    email = F.when(capitals(surface), F.upper(drawn)).otherwise(F.concat(_same_case(at(surface, 1), at(drawn, 1)), F.lit("@"), _same_case(at(surface, -1), at(drawn, -1))))
    head, body, tail = (F.regexp_extract(surface, r"(?s)" + _SECRET_PARTS, i) for i in (1, 2, 3))
    titles = F.regexp_extract(surface, _TITLES, 1)
    names = F.split(F.regexp_replace(surface, _TITLES, ""), " ")
    person = F.concat_ws(" ", titles, F.array_join(F.zip_with(names, cores, _cased), " "))
    national = F.regexp_replace(drawn, r"^\+\d{1,3} ", "")
    phone = F.when(surface.startswith("+"), F.concat(F.regexp_extract(surface, r"^(\+\d{1,3})", 1), _lay(F.regexp_replace(surface, r"^\+\d{1,3}", ""), national, "^[0-9]$")))
    secret = F.concat(head, _lay(body, F.when(capitals(body), F.upper(drawn)).otherwise(drawn), r"^[\p{L}\p{N}_/+-]$"), tail)
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", _lay(surface, F.upper(drawn), r"^[\p{L}\p{N}]$"))
        .when(kind == "ip", drawn).when(kind == "phone", phone.otherwise(_lay(surface, national, "^[0-9]$")))
        .when(kind.isin("ssn", "card"), _lay(surface, drawn, "^[0-9]$")).when(kind == "person", person).otherwise(surface)
    )


def gate(text: Column) -> Column:
    """Whether a text may hold an entity; false says that it holds none."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(_SECRET_GATE)
    return text.contains("@") | text.rlike("[0-9]") | secret | text.rlike(_PERSON_GATE)


def _pieces(text: Column) -> Column:
    """A text cut at its entities, which have every second place; an entity is a field a kind, all but one of them empty."""
    escaped = F.replace(text, F.lit(_MARK), F.lit(_ESCAPED))
    marked = F.regexp_replace(escaped, ANY, _OPEN + _NEXT.join(f"${i + 1}" for i in range(len(KINDS))) + _CLOSE)
    return F.split(marked, f"{_OPEN}|{_CLOSE}")


def _entity(field: Column) -> Column:
    """struct(surface, kind, mentions) of a found piece; kind is null for digits that are no card and letters and digits that are no IBAN."""
    def known(surface: Column, fields: Column) -> Column:
        kind = F.element_at(F.split(F.lit(" ".join(KINDS)), " "), F.array_position(F.transform(fields, lambda f: f != ""), F.lit(True)).cast("int"))
        return let(kind, lambda k: F.when(k == "card", F.when(is_card(surface), k)).when(k == "iban", F.when(is_iban(surface), k)).otherwise(k))

    of = lambda surface, kind: F.struct(surface.alias("surface"), kind.alias("kind"), mentions(kind, surface).alias("mentions"))
    return let(F.split(field, _NEXT), lambda fields: let(F.array_join(fields, ""), lambda surface: let(known(surface, fields), lambda kind: of(surface, kind))))


def _gendered(found: Column) -> Column:
    """Entities with given names behind titles of either gender as of the gender that the document gives them elsewhere, first mentions first.

    found is used more than once: a bound one.
    """
    all_ = F.array_distinct(F.flatten(F.transform(found, lambda x: x["mentions"])))
    told = F.transform(F.filter(all_, lambda m: m["kind"].isin("given_m", "given_f")), lambda m: F.struct(m["norm"].alias("norm"), m["kind"].alias("kind")))

    def settle(told: Column) -> Column:
        kind = lambda m: F.when(m["kind"] == "given_n", F.get(F.filter(told, lambda t: t["norm"] == m["norm"]), F.lit(0))["kind"])
        return F.transform(found, lambda x: x.withField("mentions", F.transform(x["mentions"], lambda m: m.withField("kind", F.coalesce(kind(m), m["kind"])))))

    return let(told, settle)


def _names(found: Column) -> Column:
    """Words that stand for names in a document's titled mentions, one mention a word; what is once a surname is one everywhere."""
    words = F.filter(F.flatten(F.transform(found, lambda x: x["mentions"])), lambda m: m["word"].isNotNull())
    ranked = F.array_sort(F.array_distinct(F.transform(words, lambda m: F.struct(m["word"].alias("word"), (m["kind"] != "surname").alias("later"), m["kind"].alias("kind"), m["norm"].alias("norm")))))
    return let(ranked, lambda r: F.filter(r, lambda m, i: (i == 0) | (F.get(r, i - 1)["word"] != m["word"])))


def found_in(text: Column) -> Column:
    """What the detectors find in a text, in order: array of (surface, kind, mentions); empty for null."""
    entities = let(_pieces(text), lambda p: let(F.transform(F.filter(p, lambda x, i: i % 2 == 1), _entity), _gendered))
    nothing = F.array().cast(f"array<struct<surface:string,kind:string,mentions:{_MENTION}>>")
    return F.when(gate(text), entities).otherwise(nothing)


def rewritten(text: Column, draw) -> Column:
    """struct(text, n): the text with all that was found replaced by what draw gives for its mentions, and the number of entities."""
    def between(piece: Column, names: Column) -> Column:
        capitals = lambda w: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(F.try_element_at(names, F.lower(w))))
        word = lambda w, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(names, w), capitals(w), w)).otherwise(w)
        return F.array_join(F.transform(F.split(F.regexp_replace(piece, rf"(?<!\p{{L}}){_NAME}", f"{_NEXT}$0{_NEXT}"), _NEXT), word), "")

    def joined(pieces: Column, found: Column, names: Column) -> Column:
        new = F.transform(found, lambda x: let(F.transform(x["mentions"], draw), lambda cores: written(x["kind"], x["surface"], cores)))
        rest = F.filter(pieces, lambda x, i: i % 2 == 0)
        rest = F.when(F.cardinality(names) > 0, F.transform(rest, lambda p: between(p, names))).otherwise(rest)
        whole = F.array_join(F.flatten(F.zip_with(rest, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        n = F.size(F.filter(found, lambda x: x["kind"].isNotNull()))
        return F.struct(F.replace(whole, F.lit(_ESCAPED), F.lit(_MARK)).alias("text"), n.cast("long").alias("n"))

    def named(found: Column) -> Column:
        # by the word itself, which begins with a capital, and by its lower case, for the same name in capitals
        entry = lambda m: let(draw(m), lambda drawn: F.struct(m["word"].alias("key"), _cased(m["word"], drawn).alias("value")))
        low = lambda m: F.struct(m["norm"].alias("key"), draw(m).alias("value"))
        first = lambda all_: F.filter(all_, lambda m, i: F.array_position(F.transform(all_, lambda x: x["norm"]), m["norm"]) == i + 1)
        return F.map_from_entries(let(_names(found), lambda all_: F.concat(F.transform(all_, entry), F.transform(first(all_), low))))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    made = let(_pieces(text), lambda p: let(
        let(F.transform(F.filter(p, lambda x, i: i % 2 == 1), _entity), _gendered), lambda found: let(named(found), lambda names: joined(p, found, names)),
    ))
    return F.when(gate(text), made).otherwise(same)


def redraws(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm; distinct) whose first draw collides, with the core that they get in the end."""
    first = cut(entities.withColumn("core", core(F.col("kind"), F.col("norm"), F.lit(0), key)), "surrogate-draws")
    settled, attempt = first.withColumn("attempt", F.lit(0)), 0
    real = first.select(F.col("kind").alias("_k"), F.col("norm").alias("_c"))
    while True:
        # a draw is taken by an earlier settled entity or, among equals, by the smallest; nor may it be a real form
        shared = settled.groupBy("kind", "core").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        twice = settled.join(shared.select("kind", "core", "owner"), ["kind", "core"]).where(F.struct("attempt", "norm") != F.col("owner")).select("kind", "norm")
        taken = settled.join(real, (F.col("kind") == F.col("_k")) & (F.col("core") == F.col("_c"))).select("kind", "norm")
        again = cut(twice.unionByName(taken).distinct(), "surrogate-clashes")
        if again.isEmpty():
            return settled.where("attempt > 0").select("kind", "norm", "core")
        attempt += 1
        kept = settled.join(again, ["kind", "norm"], "left_anti")
        redrawn = again.select("kind", "norm", core(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("core"), F.lit(attempt).alias("attempt"))
        settled = cut(kept.unionByName(redrawn), "surrogate-draws")


def settled_genders(seen: DataFrame) -> DataFrame:
    """(norm, gender) of the given names that stand behind titles of either gender in some texts of seen (kind, norm; a row a text) and behind others elsewhere.

    The gender that more texts give the name, given_f where as many do either. Sums a name, added up before they are shuffled; as many rows as names.
    """
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    told = seen.where(F.col("kind").startswith("given_")).groupBy("norm").agg(count("given_m").alias("m"), count("given_f").alias("f"), count("given_n").alias("n"))
    return told.where("n > 0 AND m + f > 0").select("norm", F.when(F.col("m") > F.col("f"), "given_m").otherwise("given_f").alias("gender"))


def pseudonymised(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with the entities of its text column replaced, and n_entities (long; a column of that name gives way): what the detectors found.

    key: see `secret_key`. Null and empty texts stay so; texts without entities stay byte for byte; equal entities get equal surrogates in
    all rows, different ones different surrogates, whatever their number; rows of one id and repeated rows are treated alike; other columns
    may have any names; no rows, no result.
    """
    key = secret_key(docs.sparkSession, key)
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(F.struct(*[column(c) for c in names]).alias("row"), column(text).alias("text"))
    of_text = F.xxhash64("text")
    both = lambda m: F.struct(m["kind"].alias("kind"), m["norm"].alias("norm"))
    named = F.array_distinct(F.flatten(F.transform(found_in(F.col("text")), lambda x: F.transform(x["mentions"], both))))
    seen = cut(rows.select(of_text.alias("h"), named.alias("m")).where(F.size("m") > 0), "surrogate-mentions").select("h", F.inline("m"))
    # a name of either gender is the same entity as that of the gender that it has elsewhere, and draws nothing of its own
    genders = cut(settled_genders(seen).select(F.lit("given_n").alias("kind"), "norm", "gender"), "surrogate-genders")
    entities = seen.select("kind", "norm").distinct().join(bounded(genders.select("kind", "norm")), ["kind", "norm"], "left_anti")
    drawn_again = cut(redraws(cut(entities, "surrogate-entities"), key), "surrogate-redraws")
    as_of = genders.join(drawn_again.select(F.col("kind").alias("gender"), "norm", "core"), ["gender", "norm"], "left")
    as_of = as_of.select("kind", "norm", F.coalesce("core", core(F.col("gender"), F.col("norm"), F.lit(0), key)).alias("core"))
    other = cut(drawn_again.unionByName(as_of), "surrogate-others")
    first = lambda m: core(m["kind"], m["norm"], F.lit(0), key)
    if other.isEmpty():
        draw = first
    else:
        # only rows that name a redrawn entity have a map; they are found by the row's text
        entry = F.struct(F.concat_ws("\u0001", "kind", "norm").alias("key"), F.col("core").alias("value"))
        maps = seen.distinct().join(other, ["kind", "norm"]).groupBy("h").agg(F.map_from_entries(F.collect_list(entry)).alias("redrawn"))
        maps = cut(maps, "surrogate-maps")
        rows = rows.join(bounded(maps), of_text == F.col("h"), "left")
        draw = lambda m: F.coalesce(F.try_element_at(F.col("redrawn"), F.concat_ws("\u0001", m["kind"], m["norm"])), first(m))
    done = rows.select("row", rewritten(F.col("text"), draw).alias("new"))
    return done.select(*[(F.col("new.text") if c == text else F.col("row").getField(c)).alias(c) for c in names], F.col("new.n").alias("n_entities"))


def private_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; same columns, n_chars following the text."""
    names = docs.columns
    out = pseudonymised(docs.select(F.struct(*[column(c) for c in names]).alias("row"), "text"), key)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "n_entities", "text")


QUERIES = {"op8_surrogates": op8_surrogates}
ORACLES: dict[str, str] = {}
