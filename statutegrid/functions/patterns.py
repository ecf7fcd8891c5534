"""Patterns, word lists and constants that results depend on.

Patterns are written once, free of look-around, for Java's and RE2's dialects alike. `java` and `re2` add the
flags: in Java ignoring case and classes are to follow Unicode, so that accents and no-break spaces count.
"""

from __future__ import annotations

# ---- fixed values: document structure -----------------------------------------------------------

ARTICLE_PREFIX = r"(?:Art[ií]culo|Artº|Art°|Art\.|Article)"
NUMERAL = r"(?:[IVXLCDM]+|\d+(?:\.\d+)?)"
SHORT_NUMERAL = r"[IVX\d]+"

SKIP = (
    r"CONSIDERANDO|VISTO|POR\s+CUANTO|HABIENDO\s+VISTO",
    r"EXPOSICI[OÓ]N\s+DE\s+MOTIVOS|PRE[AÁ]MBULO",
    r"EN\s+SU\s+VIRTUD|POR\s+LO\s+TANTO|POR\s+TANTO",
    r"Dado\s+(?:en|a)\s+|En\s+fe\s+de\s+lo\s+cual|En\s+testimonio",
    r"Firmado|Rubricado",
    r"(?:El\s+Presidente|La\s+Secretar[ií]a?|El\s+Secretario|El\s+Tesorero)\s*[,.:]?\s*$",
    r"Aprobado\s+en|Publicado\s+en\s+el|B\.O\.|D\.O\.|BOE",
    r"En\s+\w+,\s+a\s+\d+\s+de",
    r"Declaro\s+estar\s+de\s+acuerdo",
    r"Firma\s+(?:del|de\s+la|y\s+sello)",
    r"(?:R[uú]brica|Nombre\s+y\s+apellido|Lugar\s+y\s+fecha)\s*:?$",
    r"WHEREAS|RECITALS|IN\s+WITNESS\s+WHEREOF|NOW\s+THEREFORE",
    r"Signed\s+by|Dated|Approved\s+by",
    r"We\s+.{0,80}\bcome\s+together\b",
    r"The\s+above\s+\w+\s+at\s+a\s+general\s+meeting\s+held",
    r"This\s+(?:constitution|document|agreement|regulation)\s+when\s+drafted",
)
METADATA = (
    ARTICLE_PREFIX + r"\s*" + NUMERAL,
    r"Cap[ií]tulo\s+" + SHORT_NUMERAL,
    r"T[ií]tulo\s+" + SHORT_NUMERAL,
    r"Secci[oó]n\s+" + SHORT_NUMERAL,
    r"Disposici[oó]n\s+(?:adicional|transitoria|final|derogatoria)",
    r"Anexo\s+",
    r"ARTICLE\s+" + NUMERAL,
    r"Chapter\s+" + SHORT_NUMERAL,
    r"(?:Section|Sec\.)\s+" + NUMERAL,
    r"Annex\s+",
    # a keyword and nothing after it that holds an ASCII letter
    r"(?:BY-LAWS|CONSTITUTION\s+AND\s+BY-LAWS|BOARD\s+OF\s+TRUSTEES|DUTIES\s+AND\s+RESPONSIBILITIES|MEMBERSHIP|MEETINGS|QUORUM"
    r"|ELECTION\s+OF\s+OFFICERS)(?:[^a-z0-9_À-ɏ][^a-z]*)?$",
)
SIGNATURE = (
    r"Dado\s+(?:en|a)\s+|En\s+fe\s+de|En\s+testimonio|Firmado|Rubricado|Firma\s+",
    r"Declaro\s+estar|R[uú]brica|Nombre\s+y\s+apellido|Lugar\s+y\s+fecha",
    r"Aprobado\s+en|Publicado\s+en|B\.O\.|D\.O\.|BOE|En\s+\w+,\s+a\s+\d+\s+de",
    r"Signed\s+by|Dated|Approved\s+by|IN\s+WITNESS\s+WHEREOF",
    r"(?:El\s+Presidente|La\s+Secretar[ií]a?|El\s+Secretario|El\s+Tesorero)\s*[,.:]?\s*$",
)
ANNEX = r"(?:Anexo|Annex)\b"

TITLE_REF = r"T[ií]tulo\s+([IVX\d]+(?:\.[ \t]+[^\n.]{1,60})?)"
CHAPTER_REF_ES = r"Cap[ií]tulo\s+([IVX\d]+(?:[.-]\s*[^\n]{1,80})?)"
CHAPTER_REF_EN = r"Chapter\s+([IVX\d]+(?:[.:]\s*[^\n]{1,80})?)"
ARTICLE_REF = ARTICLE_PREFIX + r"\s*(" + NUMERAL + ")"
SECTION_REF = r"(?:Section|Sec\.)\s*(" + NUMERAL + ")"
INLINE_ARTICLE = "^" + ARTICLE_PREFIX + r"\s*" + NUMERAL + r"[º°]?\s*[.\-–º°:]?"
CUT_POINT = (
    "(?:" + ARTICLE_PREFIX + r"\s*" + NUMERAL + r"[º°]?\s*[.\-–º°:]?"
    r"|Cap[ií]tulo\s+[IVX\d]+|Chapter\s+[IVX\d]+|(?:Section|Sec\.)\s+" + NUMERAL + ")"
)

LINE_ITEM = r"^\s*(?:[-–—•*]\s+|\(?[a-záéíóúñ]\)\s+|\(?\d{1,2}[.)]\s+|\(?[ivxlcdm]{1,6}[.)]\s+)"
#: In this order; what none tells is a bullet.
FAMILIES = (
    ("letter", r"^\s*(?:[-–—•*]\s+)?\(?[a-záéíóúñ]\)"),
    ("roman", r"^\s*(?:[-–—•*]\s+)?\(?[ivxlcdm]{1,6}[.)]"),
    ("number", r"^\s*(?:[-–—•*]\s+)?\(?\d{1,2}[.)]"),
)
#: Upper case matters here: only lower-case letters mark items inside a line.
INLINE_ITEM = r"(\(?[a-z]\)|\d{1,2}[.)])\s+"

SENTENCE_END = r"([.!?])\s+"
#: A point behind one of these, or behind a single capital, ends no sentence.
ABBREVIATIONS = (
    "Sr Sra Srta Sres Sras Dr Dra Drs Dña Ud Uds Vd Vds Lic Ing Arq Prof Profa Excmo Excma Ilmo Ilma Art Arts Cap Sec Núm Pág Págs Aprox Av Avda Ej Mr Mrs Ms "
    "Messrs Jr St Rev Hon Gov Gen Col Capt Lt Sgt Inc Ltd Corp Co Vol Fig Vs Approx Dept Est"
).split()
ABBREVIATED = r"(^|[^\pL])((?i:" + "|".join(ABBREVIATIONS) + r")|[A-ZÁÉÍÓÚÑ])\."
SENTENCE_ITEM = r"^(?:\(?[ivxlcdm]+\)|[a-záéíóúüñ]\)|\d+[.)])\s"
BARE_LABEL = r"^(?:\(?[ivxlcdm]+\)|[a-z]\)|\d+[.)])\s*$"
SHORT_COLON = r"^.{1,50}:\s*$"
#: These two are about lower case.
DIGIT_CONTINUATION = r"^\d+\s+[a-záéíóú]"
LOWERCASE_START = r"^[a-záéíóúüñ]"

HTML_COMMENT = r"(?s)<!--.*?-->"
MARKDOWN_HEADER = r"^#{1,6}\s"
MARKDOWN_RULE = r"^[-–—]{3,}$"
MARKDOWN_EMPHASIS = r"\*{1,2}([^*]+)\*{1,2}"
MARKDOWN_LINK = r"\[([^\]]+)\]\([^)]+\)"

PAGE_BLOCK_CHARS, PARAGRAPH_ITEM_CHARS, HEADING_CHARS, INLINE_BODY_CHARS = 400, 120, 150, 10
SHORT_FRAGMENT_CHARS, SHORT_SEGMENT_CHARS, LOW_CONFIDENCE, HIGH_COUNT = 20, 25, 0.85, 3
SAMPLE_CHARS, MAX_TOKENS, BUCKET_CAP = 15_000, 256, 3

SUBSTANTIVE = ("body_sentence", "list_header", "list_item")

# ---- fixed values: languages and verbs ----------------------------------------------------------

STOPWORDS_ES = (
    "el la los las una unos unas de del al que se por como más su sus este esta ser son está y o en con para deberá podrá será "
    "artículo miembros cada cualquier"
).split()
STOPWORDS_EN = (
    "the of and to is are be that this for with by on from shall may must will not it as any all who have has or at members meeting"
).split()
DEONTIC_RE_ES = (
    r"\b(?:debe(?:n)?|debera(?:n)?|deberan|podra(?:n)?|podran|puede(?:n)?|tendra(?:n)?\s+que|tendran\s+que|habra(?:n)?\s+de|habran\s+de"
    r"|corresponde(?:ra)?|correspondera|queda(?:n)?\s+(?:obligado|prohibido|facultado))\b"
)
DEONTIC_RE_EN = r"\b(?:shall|must|should|may|will|can|have\s+to|required\s+to|obligated\s+to)\b"
#: Signs that words get for the claims of modal verbs, one sign a word; other signs come from the shapes below and from the lexicon.
SIGNS = {
    "en": {
        "m": "must shall should may will can",
        "n": "not also always never ever only then further hereby thereafter thereby forthwith so otherwise nevertheless again instead still already well",
        "a": "a an the its their his her our my your",
        "d": "this that these those any every no such another own same one two three four five six seven eight nine ten",
        "q": "each all both",
        "o": "of",
        "p": "at in on by for with from upon within without under after before during until till through per into onto over between among against about since above below beyond towards via concerning regarding",
        "t": "to",
        "u": "if when where unless while whether whenever wherever",
        "c": "and or but nor",
        "b": "be been being",
        "h": "have has had",
        "s": "it he she they we you who whom whose which what than because although though as them him us there here is are was were do does did yes if",
    },
    "es": {
        "m": "debe deben deberá deberán puede pueden podrá podrán",
        "t": "tendrá tendrán",
        "g": "habrá habrán",
        "o": "corresponde corresponden corresponderá",
        "n": "no nunca jamás siempre también tampoco sólo solo además se me te nos le les lo así ya aún todavía",
        "k": "la los las",
        "d": "el un una unos unas su sus este esta estos estas cada dicho dicha dichos dichas",
        "Q": "que",
        "Z": "de",
        "p": "a al ante bajo con contra del desde durante en entre hacia hasta mediante para por según sin sobre tras",
        "c": "y e o u ni pero",
        "b": "ser estar",
        "s": "haber lugar lugares hogar mujer taller alquiler titular particular auxiliar similar familiar regular popular ejemplar ayer cualquier tercer primer mar par azar lunar solar escolar militar",
    },
}
#: What stands between words: an end, a comma or bracket, a number.
GAPS = ((r"[.;:!?\n]", "."), (r"[,()\[\]–—]", ","), (r"[0-9]", "x"))
MANNER = {"es": r"^\p{L}{2,}mente$", "en": r"^\p{L}{2,}ly$"}
#: What words of manner end with.
MANNER_END = {"es": "mente", "en": "ly"}
NO_MANNER = {"es": [""], "en": "apply supply reply rely comply multiply imply ally rally family assembly".split()}
INFINITIVE_ES = r"^\p{L}+(?:ar|er|ir|arse|erse|irse|arlo|arla|arlos|arlas|erlo|erla|erlos|erlas)$"
CLITIC_END = r"(?:se|los|las|lo|la)$"
PARTICIPLE = {"es": r"^\p{L}+[aií]d[oa]s?$|^(?:hech|escrit|puest|vist|rot|abiert|cubiert|vuelt|resuelt|impres|elect)[oa]s?$", "en": r"^\p{L}+(?:ed|en)$"}
#: English participles of other shapes.
PARTICIPLES_EN = (
    "sold held made built lost sent spent found left put set cut let read told bought brought caught taught sought thought led fed bred dug laid met shown drawn grown known thrown worn sworn torn born borne done gone "
    "begun sunk struck stuck won understood withheld withdrawn heard shut spread leased"
).split()
NO_PARTICIPLE_EN = "proceed need exceed succeed feed heed seed weed open listen happen threaten strengthen widen deepen lengthen shorten".split()
#: English words that no modal verb can govern: too short, nouns and adjectives by their endings, what ends in a single s.
NO_BASE_EN = r"^.{1,2}$|(?:[^su]s|[^b]us)$|(?:tion|sion|ment|ness|ity|ance|ence|ship|ism|ing|ive|ous|able|ible|ary|ful|less|al)$"
BASE_EN = (
    "go mention question petition position condition commission provision supervision implement document supplement comment augment experiment advance finance influence reference experience balance enhance dance "
    "sentence commence bring sing ring swing sling fling cling sting spring string wing give live receive arrive drive strive survive forgive deprive revive enable disable vary appeal reveal deal heal steal seal signal conceal repeal total equal withdrawal focus discus gas bias"
).split()
#: Passes over a sentence's signs, in order; each keeps the number of signs. V: a word that a modal verb governs. N: a form of the lexicon that a determiner or preposition makes a noun.
_ASIDE = ",[^.,m]*(?:,[cpu][^.,m]*){0,8},n*"
CLAIMS = {
    "en": (
        ("([ptocx])M", "{1}s"), ("M(x)", "s{1}"), ("M", "m"),  # the month of May
        ("am", "as"),  # the will, a can
        ("(tn*)[vew]", "{1}s"),  # an infinitive is no modal verb's
        ("(mn*q)v", "{1}V"), ("(mn*q)[ew]([adputx.,]|$)", "{1}V{2}"),  # shall each pay
        ("([adqop]n*)v", "{1}N"),
        (f"(mn*(?:{_ASIDE})?)[vew]", "{1}V"),  # may not fish; may, at its own cost, inspect
        ("(mn*,n*)[vew]([adpx]|$)", "{1}V{2}"),  # may not, and an agent shall not, dig a well
        (f"(mn*(?:{_ASIDE})?(?:hn*)?bn*)[ve]", "{1}V"),  # shall have been paid
        (f"(mn*(?:{_ASIDE})?hn*)[ve]", "{1}V"),  # shall have paid
        (f"(mn*(?:{_ASIDE})?)h(n*(?:[^vebnV]|$))", "{1}V{2}"),  # shall have one vote
        ("(mn*[adpuqx][^.,mV]*?[vewsxN])[vw]([acdputx.,]|$)", "{1}V{2}"),  # may at its own cost inspect it
    ),
    "es": (
        ("([dkpZ]n*)v", "{1}N"),
        ("(t[^.imtgobV]*Q[nk]*)i", "{1}V"), ("(g[^.imtgobVZ]*Z[nk]*)i", "{1}V"),  # tendrá, en todo caso, que pagar; habrá de pagar
        ("([mtgo][nk]*)i", "{1}V"),  # no deberá nunca pescar
        ("([mtgo][nk]*(?:,[^.,m]*,[nk]*)?b[nk]*)[rv]", "{1}V"),  # deberá ser aprobada
        ("([pZ])i", "{1}j"),  # para pagar
        ("(m[^.imtgoQbV]*b[nk]*)[rv]", "{1}V"), ("(m[^.imtgoQbV]*)i", "{1}V"),  # podrá, previa solicitud, inspeccionar
    ),
}
MODAL_SIGNS = {"en": "m", "es": "mtgo"}
#: Verbs that are no modals and in no lexicon, which open the last search for a verb.
AUXILIARIES = {
    "es": "es son era eran fue fueron será serán sea sean está están estará estarán ha han hay había habían tiene tienen hace hacen".split(),
    "en": "is are was were be been being has have had do does did".split(),
}
DEONTICS_ES = "debe deberá podrá puede tendrá habrá corresponde".split()
DEONTICS_EN = "must shall should may will can".split()
DEONTIC_LEMMAS_ES = "deber poder tener haber corresponder".split()

# -------------------------------------------------------------------------------------------------


def java(pattern: str, case: bool = False) -> str:
    """The pattern for Spark."""
    return ("(?U)" if case else "(?iuU)") + pattern


def re2(pattern: str, case: bool = False) -> str:
    """The pattern for DuckDB."""
    return pattern if case else "(?i)" + pattern


def java_replacement(text: str) -> str:
    return text.replace("{", "$").replace("}", "")


def re2_replacement(text: str) -> str:
    return text.replace("{", "\\").replace("}", "")


def start(alternatives: tuple[str, ...]) -> str:
    """Any of the alternatives at the start."""
    return "^(?:" + "|".join(alternatives) + ")"
