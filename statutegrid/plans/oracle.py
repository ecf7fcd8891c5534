"""DuckDB SQL for the queries, written from the same fixed patterns in RE2's dialect.

The statements are a chain of common table expressions from the documents to the reviewed table; each query reads the link that it is about.
"""

from __future__ import annotations

from statutegrid.functions import lexicon as L
from statutegrid.functions import patterns as P
from statutegrid.plans.derived import LINE, TRANSITIONS

#: Newline; marks that no text holds: noncharacters, but for the one before a line, where lines have been cut.
NL, CUT, UNIT, POINT, RECORD = "chr(10)", "chr(64976)", "chr(64977)", "chr(64978)", "chr(30)"


#: A text whose vowels have no accents.
FOLDED = "translate({}, 'áéíóúàèìòùäëïöüÁÉÍÓÚÀÈÌÒÙÄËÏÖÜ', 'aeiouaeiouaeiouAEIOUAEIOUAEIOU')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(x: str, pattern: str, case: bool = False) -> str:
    return f"regexp_matches({x}, {q(P.re2(pattern, case))})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def got(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {q(P.re2(pattern))}, 1), '')"


def words(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def classify(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' OR {m(strip(x), P.start(P.SKIP))} THEN 'SKIP' WHEN {m(strip(x), P.start(P.METADATA))} THEN 'METADATA' ELSE 'RELEVANT' END"


def skip_type(x: str) -> str:
    return f"CASE WHEN {m(strip(x), P.start(P.SIGNATURE))} THEN 'signature' WHEN {m(strip(x), '^' + P.ANNEX)} THEN 'annex' ELSE 'preamble' END"


def head_type(x: str) -> str:
    return f"CASE WHEN {m(strip(x), '^' + P.ANNEX)} THEN 'annex' ELSE 'heading' END"


def family(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {m(x, p)} THEN '{f}'" for f, p in P.FAMILIES) + " ELSE 'bullet' END"


def refs(x: str) -> str:
    clean = lambda e: f"regexp_replace({strip(e)}, '[.]+$', '')"
    return f"{clean(got(x, P.TITLE_REF))} AS title, {clean(f'coalesce({got(x, P.CHAPTER_REF_ES)}, {got(x, P.CHAPTER_REF_EN)})')} AS chapter, {strip(f'coalesce({got(x, P.ARTICLE_REF)}, {got(x, P.SECTION_REF)})')} AS article"


def heading_body(source: str, name: str, text: str) -> str:
    """CTEs <name>1 to <name>: source with heading and body of its column text."""
    return f"""
{name}1 AS (SELECT *, regexp_extract({strip(text)}, {q(P.re2(P.INLINE_ARTICLE))}, 0) AS mark FROM {source}),
{name}2 AS (SELECT *, {strip(f"substr({strip(text)}, length(mark) + 1)")} AS rest0 FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN rest0 LIKE '.%' THEN {strip("substr(rest0, 2)")} ELSE rest0 END AS rest FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN mark <> '' AND length(rest) > {P.INLINE_BODY_CHARS} THEN rest ELSE '' END AS b, string_split({text}, {NL}) AS parts FROM {name}3),
{name} AS (SELECT * EXCLUDE (mark, rest0, rest, b, parts),
    CASE WHEN b <> '' THEN {strip(f"substr({text}, 1, length({text}) - length(b))")} WHEN len(parts) > 1 AND length({text}) > {P.HEADING_CHARS} THEN {strip("parts[1]")} ELSE {text} END AS heading,
    CASE WHEN b <> '' THEN b WHEN len(parts) > 1 AND length({text}) > {P.HEADING_CHARS} THEN {strip(f"array_to_string(parts[2:], {NL})")} ELSE '' END AS body FROM {name}4)"""


def sentences(x: str) -> str:
    kept = x
    for _ in range(2):
        kept = f"regexp_replace({kept}, {q(P.ABBREVIATED)}, '\\1\\2' || {POINT}, 'g')"
    parts = f"string_split(replace(regexp_replace({kept}, '([.!?])\\s+', '\\1' || {UNIT}, 'g'), {POINT}, '.'), {UNIT})"
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


def merged(x: str) -> str:
    buffer = "regexp_extract(acc, '[^\\x{fdd1}]*$')"
    takes = f"{m(buffer, P.BARE_LABEL)} OR {m(buffer, P.SHORT_COLON)}"
    part = f"{m('x', P.SENTENCE_ITEM)} OR {m('x', P.DIGIT_CONTINUATION, True)} OR {m('x', P.LOWERCASE_START, True)} OR length(x) < {P.SHORT_FRAGMENT_CHARS}"
    fold = f"CASE WHEN {takes} OR {part} THEN regexp_replace(acc, '\\s+$', '') || ' ' || x ELSE acc || {UNIT} || x END"
    return f"CASE WHEN len({x}) = 0 THEN [] ELSE list_filter(list_transform(string_split(list_reduce({x}, lambda acc, x: {fold}), {UNIT}), lambda x: {strip('x')}), lambda x: x <> '') END"


def event(kind: str, type_: str, text: str, of: bool | str = False, fam: str = "NULL") -> str:
    """of: text that references are looked for in."""
    return f"{{'kind': '{kind}', 'type': {type_}, 'text': {text}, 'refs': {of or 'NULL'}::VARCHAR, 'family': {fam}::VARCHAR}}"


MARKED = f"""CASE WHEN {m('x', P.LINE_ITEM)} THEN {RECORD} || 'i' WHEN i > 1 AND regexp_matches(x, '^[\\p{{Ll}}ºª]') THEN ' ' ELSE {RECORD} || 't' END || x"""
CLEAN = f"regexp_replace(regexp_replace(line, {q(P.MARKDOWN_EMPHASIS)}, '\\1', 'g'), {q(P.MARKDOWN_LINK)}, '\\1', 'g')"

CHAIN = f"""
reg AS (SELECT doc_id, lang, list_transform(string_split(text, {NL}), lambda line, i: {LINE.format(p='(i + doc_id)')}) AS lines FROM documents),
ln AS (SELECT doc_id, p, {strip('lines[p]')} AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM reg)),
bounds AS (SELECT *, regexp_matches(line, {q(P.MARKDOWN_HEADER)}) AS header, regexp_matches(line, {q(P.MARKDOWN_RULE)}) AS rule FROM ln),
groups AS (SELECT *, sum((header OR rule)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM bounds),
blocks0 AS (SELECT doc_id, g, header, min(p) AS p, {strip(f"string_agg(CASE WHEN header THEN regexp_replace(line, '^#{{1,6}}\\s+', '') ELSE {CLEAN} END, {NL} ORDER BY p)")} AS text
  FROM groups WHERE NOT rule AND (header OR {CLEAN} <> '') GROUP BY doc_id, g, header),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS block_no, text FROM blocks0 WHERE text <> ''),
bare AS (SELECT doc_id, block_no, {strip(f"regexp_replace(text, {q(P.HTML_COMMENT)}, ' ', 'g')")} AS text FROM blocks),
cuts AS (SELECT doc_id, block_no, CASE WHEN length(text) > {P.PAGE_BLOCK_CHARS} THEN
    list_filter(list_transform(string_split(regexp_replace(text, {q(P.re2('(^|[^0-9A-Za-z_À-ɏ])(' + P.CUT_POINT + ')'))}, '\\1' || {CUT} || '\\2', 'g'), {CUT}), lambda x: {strip('x')}), lambda x: x <> '')
    ELSE [text] END AS parts FROM bare WHERE text <> ''),
subs AS (SELECT doc_id, block_no, n - 1 AS sub_no, parts[n] AS text, {classify('parts[n]')} AS class FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM cuts)),
{heading_body('subs', 'sub', 'text')},
own AS (SELECT *, CASE class WHEN 'SKIP' THEN [{{'kind': 'skip', 'text': text, 'whole': NULL::VARCHAR}}] WHEN 'METADATA' THEN [{{'kind': 'head', 'text': coalesce(nullif(heading, ''), text), 'whole': text}}] ELSE [] END AS own,
    list_filter(list_transform(string_split(CASE class WHEN 'RELEVANT' THEN text WHEN 'METADATA' THEN body ELSE '' END, {NL}), lambda x: {strip('x')}), lambda x: x <> '') AS lines FROM sub),
marked AS (SELECT *, list_filter(string_split(array_to_string(list_transform(lines, lambda x, i: {MARKED}), ''), {RECORD}), lambda x: x <> '') AS found FROM own),
piece_lists AS (SELECT doc_id, block_no, sub_no, list_concat(own, list_transform(found, lambda x: {{'kind': CASE WHEN x LIKE 'i%' THEN 'item' ELSE 'text' END, 'text': substr(x, 2), 'whole': NULL::VARCHAR}})) AS l FROM marked),
pieces AS (SELECT doc_id, block_no, sub_no, n - 1 AS piece_no, l[n].kind AS kind, l[n].text AS text, l[n].whole AS whole FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM piece_lists)),
classed AS (SELECT *, CASE WHEN kind = 'text' THEN {classify('text')} END AS class FROM pieces),
{heading_body('classed', 'piece', 'text')},
flat AS (SELECT *, CASE WHEN kind = 'text' AND class <> 'SKIP' THEN replace(CASE WHEN class = 'METADATA' THEN body ELSE text END, {NL}, ' ') ELSE '' END AS line FROM piece),
inl0 AS (SELECT *, list_transform(string_split(regexp_replace(line, {q('(^|[:;.])(\\s*' + P.INLINE_ITEM + ')')}, '\\1' || {CUT} || '\\2', 'g'), {CUT}), lambda x: {strip('x')}) AS ip FROM flat),
inl AS (SELECT *, len(list_filter(ip[2:], lambda x: x <> '')) >= 2 AND ip[1] LIKE '%:' AS inline, list_filter(ip[2:], lambda x: x <> '') AS items, {merged(sentences('line'))} AS sents FROM inl0),
after AS (SELECT *, CASE WHEN line = '' THEN [] WHEN inline THEN list_concat([{event('L', "'list_header'", 'ip[1]', False, family('items[1]'))}], list_transform(items, lambda x: {event('C', "'list_item'", 'x')}))
    ELSE list_transform(sents, lambda x: CASE WHEN x LIKE '%:' THEN {event('H', "'list_header'", 'x')} ELSE {event('T', "'body_sentence'", 'x')} END) END AS rest FROM inl),
event_lists AS (SELECT doc_id, block_no, sub_no, piece_no, CASE
    WHEN kind = 'skip' OR class = 'SKIP' THEN [{event('X', skip_type('text'), 'text')}]
    WHEN kind = 'head' THEN [{event('X', head_type('whole'), 'text', 'whole')}]
    WHEN kind = 'item' AND regexp_replace(text, '\\s+$', '') LIKE '%:' THEN [{event('S', "'list_header'", 'text', False, family('text'))}]
    WHEN kind = 'item' THEN [{event('I', "'list_item'", 'text', False, family('text'))}]
    WHEN class = 'METADATA' THEN list_concat([{event('X', head_type('text'), "coalesce(nullif(heading, ''), text)", 'text')}], rest) ELSE rest END AS l FROM after),
events AS (SELECT doc_id, block_no, sub_no, piece_no, n - 1 AS emit_no, l[n].kind AS kind, l[n].type AS type, l[n].text AS text, l[n].refs AS refs, l[n].family AS family FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM event_lists)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, sub_no, piece_no, emit_no) AS pos, kind IN ('X', 'T', 'H', 'L', 'S') AS opens FROM events),
runs AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM placed),
run_facts AS (SELECT doc_id, run, max(kind) FILTER (opens) AS opener, coalesce(max(family) FILTER (kind = 'L'), min_by(family, pos) FILTER (kind = 'I')) AS fam FROM runs GROUP BY doc_id, run),
judged AS (SELECT r.*, f.opener, f.fam FROM runs r LEFT JOIN run_facts f ON f.doc_id = r.doc_id AND f.run = r.run - (r.kind = 'S')::INT),
broken AS (SELECT doc_id, run, min(pos) FILTER (kind = 'I' AND family <> fam) AS broke FROM judged GROUP BY doc_id, run),
states AS (SELECT j.*, CASE WHEN j.kind IN ('I', 'S') THEN coalesce(j.opener NOT IN ('H', 'L', 'S'), true) OR coalesce(j.family <> j.fam, false) OR coalesce(b.broke <= j.pos, false) END AS closed
  FROM judged j LEFT JOIN broken b ON b.doc_id = j.doc_id AND b.run = j.run - (j.kind = 'S')::INT),
list_state AS (SELECT *, coalesce(kind = 'I' AND closed AND length(text) >= {P.PARAGRAPH_ITEM_CHARS}, false) AS splits FROM states),
spread AS (SELECT *, CASE WHEN splits THEN {merged(sentences('text'))} ELSE [text] END AS parts FROM list_state),
parts AS (SELECT * EXCLUDE (parts), n AS part_no, parts[n] AS segment_text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM spread)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part_no) AS segment_order, {refs('refs')} FROM parts),
linked AS (SELECT * EXCLUDE (title, chapter, article),
    last_value(title IGNORE NULLS) OVER w AS title, last_value(chapter IGNORE NULLS) OVER w AS chapter, last_value(article IGNORE NULLS) OVER w AS article,
    max(CASE WHEN opens THEN segment_order END) OVER b AS header, max(CASE WHEN splits THEN segment_order END) OVER r AS paragraph FROM numbered
  WINDOW w AS (PARTITION BY doc_id ORDER BY segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY doc_id ORDER BY segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY doc_id, run ORDER BY segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parents AS (SELECT *, CASE WHEN kind = 'C' OR (kind IN ('I', 'S') AND NOT closed) THEN header WHEN kind = 'I' AND NOT splits THEN coalesce(paragraph, CASE WHEN opener = 'T' THEN header END) END AS parent,
    CASE WHEN splits THEN 'body_sentence' ELSE type END AS segment_type FROM linked),
segments AS (SELECT doc_id, printf('seg_%04d', segment_order) AS segment_id, CASE WHEN parent IS NOT NULL THEN printf('seg_%04d', parent) END AS parent_segment_id, segment_order, title, chapter, article, segment_type,
    segment_type = 'list_item' AS is_list_item, segment_type IN {words(list(P.SUBSTANTIVE))} AS is_substantive, segment_text FROM parents)"""


def lexicon_values() -> str:
    forms = [(lang, form, lemma, L.lookup_verb_type(lemma, lang), False) for lang in ("es", "en") for form, lemma in L.verb_forms(lang).items() if form not in L.deontic_forms(lang)]
    forms += [(lang, form, lemma, None, True) for lang in ("es", "en") for form, lemma in L.deontic_forms(lang).items()]
    return ", ".join(f"({q(a)}, {q(f)}, {q(l)}, {q(c) if c else 'NULL'}, {str(d).lower()})" for a, f, l, c, d in forms)


def lexicon_rows() -> str:
    return ", ".join(f"({q(lang)}, {n}, {q(c)}, {q(lemma)})" for lang, by in L.LEXICON.items() for n, (c, lemmas) in enumerate(by.items()) for lemma in lemmas)


def _either(make) -> str:
    """A condition for each language; other languages are read as Spanish."""
    return f"CASE WHEN language = 'en' THEN {make('en')} ELSE {make('es')} END"


def _sign(lang: str) -> str:
    """A word's sign, from its own, its shape and the lexicon."""
    own = " ".join(f"WHEN w IN {words(listed.split())} THEN '{sign}'" for sign, listed in P.SIGNS[lang].items())
    shape = lambda p: f"regexp_matches(w, {q(p)})"
    manner = f"WHEN {shape(P.MANNER[lang])} AND w NOT IN {words(P.NO_MANNER[lang])} THEN 'n'"
    if lang == "es":
        return f"CASE {own} {manner} WHEN {shape(P.INFINITIVE_ES)} THEN 'i' WHEN known IS NOT NULL THEN 'v' WHEN {shape(P.PARTICIPLE['es'])} THEN 'r' ELSE 'w' END"
    return f"""CASE WHEN t = 'May' THEN 'M' {own} {manner} WHEN known IS NOT NULL THEN 'v' WHEN w IN {words(P.PARTICIPLES_EN)} OR ({shape(P.PARTICIPLE['en'])} AND w NOT IN {words(P.NO_PARTICIPLE_EN)}) THEN 'e'
    WHEN w IN {words(P.BASE_EN)} OR NOT {shape(P.NO_BASE_EN)} THEN 'w' ELSE 's' END"""


def _claims(lang: str) -> str:
    signs = "signs"
    for pattern, into in P.CLAIMS[lang]:
        signs = f"regexp_replace({signs}, {q(pattern)}, {q(P.re2_replacement(into))}, 'g')"
    return signs


def aims(source: str, key: str, name: str = "aims", auxiliaries: bool = False) -> str:
    """CTEs up to <name> (key, verb, lemma, position, suggested_type) of source (key, text, language). auxiliaries: they count too."""
    keys, same = ", ".join(key.split()), " AND ".join(f"x.{k} = y.{k}" for k in key.split())
    gap = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN '{sign}'" for p, sign in P.GAPS) + " ELSE '' END"
    modal = _either(lambda lang: f"mark IN {words(list(P.MODAL_SIGNS[lang]))}")
    more = " OR " + _either(lambda lang: f"w IN {words(P.AUXILIARIES[lang])}") if auxiliaries else ""
    return f"""
{name}_forms(language, form, lemma, category, modal) AS (VALUES {lexicon_values()}),
{name}_tok0 AS (SELECT {keys}, language, string_split(regexp_replace(text, '(\\p{{L}}+)', {CUT} || '\\1' || {CUT}, 'g'), {CUT}) AS parts FROM {source}),
{name}_tok1 AS (SELECT {keys}, language, n, parts[n] AS t FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM {name}_tok0)),
{name}_tok2 AS (SELECT *, lower(t) AS w, regexp_matches(t, '^\\p{{L}}') AS word, coalesce(sum(length(t)) OVER (PARTITION BY {keys} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM {name}_tok1),
{name}_tok3 AS (SELECT x.*, CASE WHEN NOT f.modal THEN f.lemma END AS known, f.lemma AS any_lemma FROM {name}_tok2 x LEFT JOIN {name}_forms f ON f.language = x.language AND f.form = x.w AND x.word),
{name}_tok4 AS (SELECT * FROM (SELECT *, CASE WHEN word THEN {_either(_sign)} ELSE {gap} END AS sign FROM {name}_tok3) WHERE sign <> ''),
{name}_tok5 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n) AS place FROM {name}_tok4),
{name}_passes AS (SELECT {keys}, {_either(_claims)} AS marks FROM (SELECT {keys}, language, string_agg(sign, '' ORDER BY n) AS signs FROM {name}_tok4 GROUP BY {keys}, language)),
{name}_tok6 AS (SELECT x.*, substr(marks, place, 1) AS mark FROM {name}_tok5 x JOIN {name}_passes y ON {same}),
{name}_tok7 AS (SELECT *, {modal} AS modal FROM {name}_tok6 WHERE {modal} OR mark = 'V' OR (known IS NOT NULL AND mark <> 'N'){more}),
{name}_tok8 AS (SELECT *, CASE WHEN modal THEN any_lemma ELSE coalesce(known, CASE WHEN language = 'es' THEN regexp_replace(w, {q(P.CLITIC_END)}, '') ELSE w END) END AS lemma FROM {name}_tok7),
{name}_tok9 AS (SELECT x.*, lex.category AS kind, row_number() OVER (PARTITION BY {', '.join('x.' + k for k in key.split())}, x.lemma ORDER BY n) AS turn FROM {name}_tok8 x
  LEFT JOIN (SELECT DISTINCT language, lemma, category FROM {name}_forms WHERE NOT modal) lex ON lex.language = x.language AND lex.lemma = x.lemma AND NOT x.modal),
{name} AS (SELECT {keys}, t AS verb, lemma, position::INT AS position, kind AS suggested_type, n FROM {name}_tok9 WHERE turn = 1)"""


TABLE = f"""
spoken AS (SELECT doc_id, segment_order, segment_text AS text, 'es' AS language FROM segments),
{aims('spoken', 'doc_id segment_order')},
per AS (SELECT doc_id, segment_order, count(*) AS n, string_agg(verb, ' | ' ORDER BY position) AS verbs FROM aims GROUP BY doc_id, segment_order),
cand AS (SELECT s.*, coalesce(n, 0)::INT AS aim_n_suggested, CASE WHEN n IS NULL THEN '' ELSE substr(repeat(' | ' || segment_text, n), 4) END AS aim_text_candidate, coalesce(verbs, '') AS aim_trigger_candidate,
    NULL::DOUBLE AS aim_candidate_confidence, coalesce(n >= 1, false) AS has_own_aim_candidate FROM segments s LEFT JOIN per USING (doc_id, segment_order)),
flagged AS (SELECT *, concat_ws(';', CASE WHEN is_substantive AND length(segment_text) < {P.SHORT_SEGMENT_CHARS} THEN 'short_segment' END,
    CASE WHEN is_substantive AND has_own_aim_candidate AND aim_candidate_confidence < {P.LOW_CONFIDENCE} THEN 'low_confidence' END,
    CASE WHEN segment_type = 'body_sentence' AND regexp_matches(segment_text, '^[\\p{{Ll}}ºª]') THEN 'possible_bad_split' END,
    CASE WHEN is_list_item AND parent_segment_id IS NULL THEN 'list_item_no_parent' END,
    CASE WHEN aim_n_suggested >= {P.HIGH_COUNT} THEN 'high_aim_count' END,
    CASE WHEN NOT is_substantive AND has_own_aim_candidate THEN 'context_filter_conflict' END) AS review_reason FROM cand),
final AS (SELECT doc_id, doc_id::INT AS case_id, NULL::VARCHAR AS system, segment_id, parent_segment_id, segment_order::INT AS segment_order, title, chapter, article, segment_type, is_list_item, is_substantive, segment_text,
    aim_n_suggested, aim_text_candidate, aim_trigger_candidate, aim_candidate_confidence, has_own_aim_candidate, review_reason <> '' AS needs_review, review_reason, 'heuristic_extractor' AS model_version,
    doc_id || '. Reglamento.md' AS source_base FROM flagged)"""


def of(select: str, table: bool = False, more: str = "") -> str:
    return f"WITH {CHAIN.strip()}{',' + TABLE if table else ''}{',' + more if more else ''}\n{select}"


LOGITS = f"""
tok AS (SELECT vec_id, list_transform(range(0, 21), lambda i: list_transform(embedding[3 * i + 1:3 * i + 3], lambda x: x::DOUBLE)) AS logits, list_transform(embedding[62:64], lambda x: x::DOUBLE) AS ordinals,
    substr(repeat('abc ', 20), 1, 79) AS text FROM embeddings),
tags AS (SELECT *, list_transform(logits, lambda l: (list_position(l, list_max(l)) - 1)::INT) AS tags FROM tok)"""


def spans(source: str) -> str:
    """CTE spans (vec_id, k, start, end, text) of source (vec_id, text, tags): token 0 is special, token i covers characters 4 (i - 1) to 4 i - 1."""
    return f"""
tg AS (SELECT vec_id, text, i, CASE WHEN i = 0 THEN 0 ELSE tags[i + 1] END AS tag FROM (SELECT *, unnest(range(0, 21)) AS i FROM {source})),
st AS (SELECT *, tag = 1 OR (tag = 2 AND coalesce(lag(tag) OVER (PARTITION BY vec_id ORDER BY i), 0) = 0) AS begins FROM tg),
gr AS (SELECT *, sum(begins::INT) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM st WHERE tag > 0),
spans AS (SELECT vec_id, g, (4 * (min(i) - 1))::INT AS s, (4 * max(i) - 1)::INT AS e, {strip('substr(any_value(text), 4 * (min(i) - 1) + 1, 4 * max(i) - 1 - 4 * (min(i) - 1))')} AS t FROM gr GROUP BY vec_id, g)"""


def viterbi() -> str:
    def best(options: list[str], value: str) -> str:
        # the first of the largest
        tests = [f"WHEN {' AND '.join(f'{a[0]} >= {b[0]}' for b in options if b is not a)} THEN {a[1 if value == 'path' else 0]}" for a in options]
        return f"CASE {' '.join(tests)} END"

    step = []
    for j in range(3):
        options = [(f"(a.s{i} + {TRANSITIONS[i][j]})", f"a.p{i}") for i in range(3)]
        step += [f"'s{j}': {best(options, 'score')} + x.s{j}", f"'p{j}': {best(options, 'path')} || '{j}'"]
    order = [f"'s{j}'" for j in range(3)] + [f"'p{j}'" for j in range(3)]
    fields = {s.split(":")[0]: s for s in step}
    fold = "{" + ", ".join(fields[o] for o in order) + "}"
    token = "{" + ", ".join(f"'s{j}': l[{j + 1}]" for j in range(3)) + ", " + ", ".join(f"'p{j}': '{j}'" for j in range(3)) + "}"
    last = best([(f"v.s{j}", f"v.p{j}") for j in range(3)], "path")
    return f"WITH {LOGITS}, vit AS (SELECT vec_id, list_reduce(list_transform(logits, lambda l: {token}), lambda a, x: {fold}) AS v FROM tok) SELECT vec_id, {last} AS tags FROM vit"


def losses() -> str:
    total = lambda values: f"(list_max({values}) + ln(list_sum(list_transform({values}, lambda v: exp(v - list_max({values}))))))"
    step = "[" + ", ".join(f"{total('[' + ', '.join(f'(a[{i + 1}] + {TRANSITIONS[i][j]})' for i in range(3)) + ']')} + x[{j + 1}]" for j in range(3)) + "]"
    soft = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
    part = lambda k: f"sum(y[{k}] * {soft(f'-ordinals[{k}]')}) AS p{k}, sum((1 - y[{k}]) * {soft(f'ordinals[{k}]')}) AS n{k}, sum(y[{k}])::DOUBLE AS y{k}"
    weight = lambda k: f"least(greatest(n - greatest(y{k}, 1), 1) / greatest(y{k}, 1), 50)"
    return f"""WITH {LOGITS},
lab AS (SELECT vec_id, vec_id % 5 AS batch, vec_id % 4 AS aim_n, logits, ordinals, logits[2:] AS x, list_transform(range(1, 21), lambda i: (vec_id + i) % 3) AS l, list_transform([1, 2, 3], lambda k: (vec_id % 4 >= k)::INT) AS y FROM tok),
fwd AS (SELECT *, list_reduce(x, lambda a, x: {step}) AS z,
  list_sum(list_transform(range(1, 21), lambda i: x[i][l[i] + 1])) + list_sum(list_transform(range(1, 20), lambda i: ({TRANSITIONS}::DOUBLE[][])[l[i] + 1][l[i + 1] + 1])) AS path FROM lab),
sums AS (SELECT batch, count(*) AS n, avg({total('z')} - path) AS span_loss, {', '.join(map(part, (1, 2, 3)))},
  sum(list_sum(list_transform(logits, lambda t: t[2] + t[3]))) FILTER (aim_n = 0) / greatest(sum(len(logits)) FILTER (aim_n = 0), 1) AS penalty FROM fwd GROUP BY batch),
made AS (SELECT batch, n, span_loss, ({' + '.join(f'{weight(k)} * p{k} + n{k}' for k in (1, 2, 3))}) / (3 * n) AS ordinal_loss, penalty FROM sums)
SELECT batch, n, round(span_loss, 6) AS span_loss, round(ordinal_loss, 6) AS ordinal_loss, round(penalty, 6) AS penalty, round(span_loss + 0.3 * ordinal_loss + 0.5 * coalesce(penalty, 0), 6) AS loss FROM made"""


def evaluation() -> str:
    kinds = range(P.BUCKET_CAP + 1)
    pair = lambda k: f"2.0 * count(*) FILTER (g = {k} AND c = {k}) / nullif(count(*) FILTER (g = {k}) + count(*) FILTER (c = {k}), 0)"
    touch = lambda a, b: f"list_sum(list_transform({a}, lambda s: (len(list_filter({b}, lambda o: o.s < s.e AND s.s < o.e)) > 0)::INT))"
    each = lambda name, source: f"{name} AS (WITH {spans(source)} SELECT vec_id, list({{'s': s, 'e': e}}) AS l FROM spans WHERE t <> '' GROUP BY vec_id)"
    return f"""WITH {LOGITS}, held AS (SELECT vec_id, text, list_transform(range(0, 21), lambda i: CASE (vec_id + i) % (vec_id % 23 + 5) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS tags FROM tok),
{each('p', 'tags')}, {each('h', 'held')},
b AS (SELECT vec_id % 4 AS version, vec_id % 7 IN (0, 1) AS bad, coalesce(p.l, []) AS p, coalesce(h.l, []) AS h FROM tok LEFT JOIN p USING (vec_id) LEFT JOIN h USING (vec_id)),
x AS (SELECT *, least(len(h), {P.BUCKET_CAP}) AS g, least(len(p), {P.BUCKET_CAP}) AS c FROM b WHERE NOT bad),
f AS (SELECT version, count(*) AS n, [{', '.join(map(pair, kinds))}] AS f, count(*) FILTER (g = 0 AND c = 0) / nullif(count(*) FILTER (g = 0), 0) AS r0, count(*) FILTER (g > 0 AND c > 0) / nullif(count(*) FILTER (g > 0), 0) AS r1,
  sum({touch('p', 'h')}) / nullif(sum(len(p)), 0) AS sp, sum({touch('h', 'p')}) / nullif(sum(len(h)), 0) AS sr FROM x GROUP BY version)
SELECT version, n, (SELECT count(*) FROM b WHERE bad AND b.version = f.version) AS n_excluded, round(list_avg(list_filter(f, lambda v: v IS NOT NULL)), 6) AS count_macro_f1, round(r0, 6) AS recall_aim0,
  round(r1, 6) AS recall_aim_ge1, round(sp, 6) AS span_precision, round(sr, 6) AS span_recall, round(2 * sp * sr / (sp + sr), 6) AS span_f1_partial FROM f"""
