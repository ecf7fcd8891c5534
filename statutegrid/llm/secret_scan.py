"""Operator 13, scans for secrets.

Each whole text is read once. Three base patterns (assignments, access keys, hexadecimal runs) give spans as they are. The method then looks at
candidate strings, long runs of token signs: inside them, for each character class by itself, a window of fixed length slides over the runs of
that class, and the Shannon entropy of its characters follows from counts that change by one character in and one out. What windows of high entropy cover is a
span of that class, unless the candidate is on the allow list or a span before it covers it already. Entropies are compared as sums of whole numbers, so that any engine decides alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutegrid.functions.ship import map_arrow
from statutegrid.llm.common import free_name, table

# ---- fixed values: base patterns, least lengths -------------------------------------------------

ASSIGN, ASSIGN_CHARS = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12
ACCESS, ACCESS_CHARS = r"AKIA[A-Z0-9]+", 18
HEX, HEX_CHARS = r"[0-9a-f]+", 16
BASE = ("assign", "access", "hex")

# -------------------------------------------------------------------------------------------------

#: Candidates: runs of these signs, at least so long.
TOKEN, TOKEN_CHARS = r"A-Za-z0-9+/_=-", 20
#: c * log2(c) as a whole number of so many parts.
PARTS = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window that slides over its runs, and the least entropy (bits a character) of a window that tells a secret.

    Such a window holds at least `least` digits and as many letters: numbers and words have neither.
    """

    name: str
    chars: str
    window: int
    bits: float
    least: int = 2

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c), in parts, of a window of high entropy."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * PARTS)


#: Random hexadecimal windows of 20 have 3.4 bits on average, random ones of letters and digits 4.1, words of one language some 3.5 without digits.
CLASSES = (
    CharClass("hexadecimal", "0-9A-Fa-f", 20, 3.0),
    CharClass("alphanumeric", "A-Za-z0-9", 20, 3.7),
    CharClass("base64", "A-Za-z0-9+/_=-", 24, 4.1, 3),
)
#: Candidates that are no secrets: identifiers of the UUID form, digests named as such, placeholders, rows of the alphabet and of digits, words and numbers joined by signs.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:sha1|sha256|sha384|sha512|md5)[-_=]",
    r"EXAMPLE|Example|example|SAMPLE|Sample|sample|PLACEHOLDER|Placeholder|placeholder|CHANGEME|changeme|XXXX|xxxx",
    r"abcdefgh|ABCDEFGH|12345678|87654321|qwertyui|QWERTYUI",
    r"^[+/_=-]*(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))*[+/_=-]*$",
)

_assign, _access, _hex = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS), re.compile(f"[0-9a-f]{{{HEX_CHARS},}}")
_PARTS = [round(c * math.log2(c) * PARTS) if c else 0 for c in range(max(c.window for c in CLASSES) + 1)]

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end: code points) of the base patterns, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    # a run of 16 and more begins where a run begins
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return [(BASE[k], s, e) for s, k, e in sorted(found)]


def high_stretches(run: str, of: CharClass) -> list[tuple[int, int]]:
    """What windows of high entropy cover of a run of the class, as (start, end), neighbours put together; counts change by a character in and one out."""
    counts: dict[str, int] = {}
    total = digits = letters = 0
    most, out = of.most, []
    parts = _PARTS if of.window < len(_PARTS) else [round(c * math.log2(c) * PARTS) if c else 0 for c in range(of.window + 1)]
    for at, sign in enumerate(run):
        n = counts.get(sign, 0)
        counts[sign] = n + 1
        total += parts[n + 1] - parts[n]
        digits += "0" <= sign <= "9"
        letters += "A" <= sign <= "Z" or "a" <= sign <= "z"
        start = at - of.window + 1
        if start < 0:
            continue
        if total <= most and digits >= of.least and letters >= of.least:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((start, at + 1))
        gone = run[start]
        n = counts[gone]
        counts[gone] = n - 1
        total += parts[n - 1] - parts[n]
        digits -= "0" <= gone <= "9"
        letters -= "A" <= gone <= "Z" or "a" <= gone <= "z"
    return out


class Scanner:
    """Base spans and those of high entropy, with the character classes and the allow list that it is given."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = classes
        self.runs = [re.compile(f"[{c.chars}]{{{c.window},}}") for c in classes]
        self.allowed = [re.compile(p) for p in allowed]
        self.candidates = re.compile(f"[{TOKEN}]{{{min([TOKEN_CHARS] + [c.window for c in classes])},}}")

    def spans(self, text: str | None) -> list[Span]:
        """All spans by start, then kind: base ones as they are, then the classes' in their order; null texts have none."""
        text = text or ""
        base = base_spans(text)
        ranked = [(s, BASE.index(k), e, k) for k, s, e in base]
        seen, near = 0, []
        for candidate in self.candidates.finditer(text):
            # both sides ascend: base spans that reach into this candidate
            while seen < len(base) and base[seen][1] < candidate.end():
                near.append(base[seen][1:])
                seen += 1
            near = [(s, e) for s, e in near if e > candidate.start()]
            if any(p.search(candidate[0]) for p in self.allowed):
                continue
            known = list(near)
            for n, (of, runs) in enumerate(zip(self.classes, self.runs, strict=True)):
                found = []
                for run in runs.finditer(text, candidate.start(), candidate.end()):
                    found += [(run.start() + s, run.start() + e) for s, e in high_stretches(run[0], of)]
                found = [(s, e) for s, e in found if not any(a <= s and e <= b for a, b in known)]
                known += found
                ranked += [(s, len(BASE) + n, e, of.name) for s, e in found]
        return [(k, s, e) for s, _, e, k in sorted(ranked)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """The text with each stretch that spans cover replaced by one mark; null stays null."""
    if text is None:
        return None
    out, end = [], 0
    for _, s, e in spans:
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join([*out, text[end:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """docs with secrets: spans (kind, start, end) of the text in code points, by start, then kind; an input column of that name gives way.

    Null and empty texts have none, however long texts are read whole; equal texts have equal spans, repeated rows stay; ids play no part; an empty table gives no rows; other columns may
    have any names. Texts are read where they lie: nothing is shuffled.
    """
    scanner = scanner or Scanner()
    kept = [c for c in docs.columns if c != "secrets"]
    at = kept.index(text)
    source = docs.select(*[docs["`" + c.replace("`", "``") + "`"] for c in kept])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t.as_py())] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "secrets"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in source.schema), f"secrets {SPANS}"])
    return map_arrow(source, spans, schema)


def without_secrets(docs: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """docs with the secrets of their texts replaced by a mark; same rows, same columns."""
    scanner = scanner or Scanner()
    at = docs.columns.index(text)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t.as_py(), scanner.spans(t.as_py())) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))

    return map_arrow(docs, cleaned, docs.schema)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[number(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def _matches(name: str, source: str, pattern: str) -> str:
    """CTE <name> (id, s, e, x): matches of a pattern in source (id, low, text), positions counted from low."""
    return f"""
{name}_lists AS (SELECT id, low, regexp_extract_all(text, {pattern}) AS m, regexp_split_to_array(text, {pattern}) AS g FROM {source} WHERE regexp_matches(text, {pattern})),
{name}_rows AS (SELECT id, low, k, m[k] AS x, length(g[k]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_lists)),
{name} AS (SELECT id, low + sum(gap + length(x)) OVER (PARTITION BY id, low ORDER BY k) - length(x) AS s, low + sum(gap + length(x)) OVER (PARTITION BY id, low ORDER BY k) AS e, x FROM {name}_rows)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: ASCII letters in either case; ignoring case would take other alphabets' signs for them.
_ASSIGN_SQL = _quoted(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", ASSIGN.split(")[")[0]) + ")[" + ASSIGN.split(")[", 1)[1])


def _class_sql(n: int, of: CharClass) -> str:
    """CTE stretch<n> (id, kind, s, e) of a character class."""
    entropy = f"list_sum(list_transform(list_distinct(c), lambda x: ({_PARTS}::BIGINT[])[len(list_filter(c, lambda y: y = x)) + 1]))"
    count = lambda signs: f"len(list_filter(c, lambda y: regexp_matches(y, '[{signs}]')))"
    return f"""{_matches(f"run{n}", "candidates", _quoted(f"[{of.chars}]{{{of.window},}}"))},
window{n} AS (SELECT id, s, i, string_split(substr(x, i + 1, {of.window}), '') AS c FROM (SELECT *, unnest(range(0, length(x) - {of.window - 1})) AS i FROM run{n})),
high{n} AS (SELECT id, s, i, coalesce(i - lag(i) OVER (PARTITION BY id, s ORDER BY i) > {of.window}, true) AS first FROM window{n} WHERE {entropy} <= {of.most} AND {count("0-9")} >= {of.least} AND {count("A-Za-z")} >= {of.least}),
stretch{n} AS (SELECT id, '{of.name}' AS kind, {len(BASE) + n} AS rank, s + min(i) AS s, s + max(i) + {of.window} AS e FROM (SELECT *, sum(first::INT) OVER (PARTITION BY id, s ORDER BY i) AS g FROM high{n}) GROUP BY id, s, g)"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, 0 AS low, coalesce(text, '') AS text FROM documents),
{_matches("assigns", "docs", _ASSIGN_SQL).strip()},
{_matches("accesses", "docs", _quoted(ACCESS)).strip()},
{_matches("hexes", "docs", _quoted(f"[0-9a-f]{{{HEX_CHARS},}}")).strip()},
base AS (SELECT id, 'assign' AS kind, 0 AS rank, s, e FROM assigns WHERE length(regexp_extract(x, {_ASSIGN_SQL}, 2)) >= {ASSIGN_CHARS}
  UNION ALL SELECT id, 'access', 1, s, e FROM accesses WHERE length(x) >= {ACCESS_CHARS} UNION ALL SELECT id, 'hex', 2, s, e FROM hexes),
{_matches("tokens", "docs", _quoted(f"[{TOKEN}]{{{TOKEN_CHARS},}}")).strip()},
candidates AS (SELECT id, s AS low, x AS text FROM tokens WHERE NOT ({" OR ".join(f"regexp_matches(x, {_quoted(p)})" for p in ALLOWED)})),
{", ".join(_class_sql(n, c).strip() for n, c in enumerate(CLASSES))},
stretches AS (SELECT * FROM base {" ".join(f"UNION ALL SELECT * FROM stretch{n}" for n in range(len(CLASSES)))}),
kept AS (SELECT * FROM stretches x WHERE rank < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM stretches y WHERE y.id = x.id AND y.rank < x.rank AND y.s <= x.s AND x.e <= y.e)),
per AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (id)
"""

QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES = {"op13_secret_scan": SQL}
