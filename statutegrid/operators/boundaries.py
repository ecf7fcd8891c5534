"""Sentence ends learnt from the texts: which points belong to abbreviations is told by how often words stand before a point.

For each word two hypotheses are weighed, that a point follows it as it follows any word or nearly always; the log likelihood ratio, damped by the word's length and by its
occurrences without a point, tells abbreviations (after Kiss and Strunk, 2006). Behind an abbreviation a sentence ends only before a word in upper case that inside sentences is written in
lower case alone and begins at least as many sentences behind other words. All counts are sums by word, added up before they are shuffled. A decision is about a pair of words, the abbreviation and the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions import patterns as P
from statutegrid.functions.text import let, strip
from statutegrid.operators.sentences import BREAK

#: An abbreviation scores this much at least; a point follows it with this probability.
LEAST_SCORE, NEARLY_ALWAYS = 0.3, 0.99
#: Pairs that travel inside the plan, by number and bytes; more of them are joined.
PLAN_PAIRS, PLAN_BYTES = 50_000, 4 << 20

BLANKS = r"[ \t\n\r\f]+"
TRAIL = r"[^\p{L}0-9.]+$"
WORD = r"(\p{L}(?:[\p{L}.']*\p{L})?)\.?$"
POINTED = r"(\p{L}(?:[\p{L}.']*\p{L})?)\.$"
NEXT = r"^[^\p{L}0-9]*(\p{L}(?:[\p{L}.']*\p{L})?)"
STOP = r"[.!?:][^\p{L}0-9]*$"
CUT = r"([.!?])([ \t\n\r\f]+)"


def _spellings(texts: DataFrame) -> DataFrame:
    """What stands between blanks in texts (text), as it is spelt: (t, stop, times), stop: whether a sentence may end before it."""
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda x: x != "")
    # nothing stands before a text's first word: neither a stop nor the inside of a sentence
    rows = let(tokens, lambda all_: F.transform(all_, lambda x, n: F.struct(x.alias("t"), F.when(n > 0, F.get(all_, n - 1).rlike(STOP)).otherwise(True).alias("stop"))))
    return texts.select(F.inline(rows)).groupBy("t", "stop").agg(F.count("*").alias("times"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, pointed, low, inside) over all texts (text); null and blank texts have no words. The empty word stands for what holds no letter.

    Counted by spelling first: what patterns tell of a word is worked out once a spelling, not once an occurrence.
    """
    bare = F.regexp_replace("t", TRAIL, "")
    found = _spellings(texts).select(F.regexp_extract(bare, WORD, 1).alias("w"), bare.endswith(".").alias("pointed"), "stop", "times")
    counted = {"n": F.lit(True), "pointed": F.col("pointed"), "low": F.col("w").rlike(r"^\p{Ll}"), "inside": F.col("w").rlike(r"^\p{Lu}") & ~F.col("stop")}
    rows = found.select(F.lower("w").alias("word"), *[F.when(is_, F.col("times")).otherwise(0).alias(c) for c, is_ in counted.items()])
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in counted])


def score(n: Column, pointed: Column, word: Column, all_n: Column, all_pointed: Column) -> Column:
    """How much a word looks like an abbreviation. A word that never stands before a point scores nothing."""
    share = F.coalesce(all_pointed.cast("double") / F.nullif(all_n, F.lit(0)), F.lit(0.5))
    usual = F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
    rest = (n - pointed).cast("double")
    fits = lambda p: pointed * F.log(p) + rest * F.log(1 - p)
    points = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = (F.length(word) - points).cast("double")
    return 2 * (fits(F.lit(NEARLY_ALWAYS)) - fits(usual)) * F.exp(-letters) * (points + 1) * F.pow(letters, -rest)


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The words of `word_counts` that are abbreviations: (word, n, pointed, score). The sums over all words are a row that is joined to them, from the same counts."""
    total = counts.agg(F.sum("n").alias("_all_n"), F.sum("pointed").alias("_all_pointed"))
    known = counts.select("word", "n", "pointed").crossJoin(F.broadcast(total))
    # one condition: a test of the word alone would be made before the counts, which then were others than those of the sums
    scores = F.when((F.col("word") != "") & (F.col("pointed") > 0), score(F.col("n"), F.col("pointed"), F.col("word"), F.col("_all_n"), F.col("_all_pointed")))
    return known.withColumn("score", scores).where(F.col("score") >= least).select("word", "n", "pointed", "score")


def _pieces(text: Column) -> Column:
    """The text cut behind each end of a sentence; pieces keep the blanks before them."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CUT, "$1" + BREAK + "$2"), BREAK)


def _pair(piece: Column, following: Column) -> Column:
    """The word before a piece's last point and the first of the next piece; null where the piece ends in no word and point. Numbers and signs are alike."""
    word, after = F.regexp_extract(piece, POINTED, 1), F.regexp_extract(strip(following), NEXT, 1)
    return F.when(word != "", F.concat(word, F.lit(" "), F.when(after != "", after).otherwise("#")))


def pairs_of(text: Column) -> Column:
    """All pairs of a text: what stands on the two sides of a point that may end a sentence."""
    return let(_pieces(text), lambda p: F.filter(F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, n: _pair(x, F.get(p, n + 1))), lambda x: x.isNotNull()))


def going_on(texts: DataFrame, counts: DataFrame, least: float = LEAST_SCORE, prior: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The pairs of texts (text) between which the sentence goes on: (pair).

    counts: `word_counts` of these or of other texts. prior: abbreviations that need no evidence. Single capitals are initials. Pairs are made
    distinct before anything is joined to them, so no frequent word weighs more than its neighbours' number.
    """
    short = abbreviations(counts, least).select(F.col("word").alias("_short"))
    if prior:
        listed = texts.sparkSession.createDataFrame([(w.lower(),) for w in prior], "_short string")
        short = short.unionByName(listed).distinct()
    pairs = texts.select(F.explode(pairs_of(F.col("text"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("times"))
    pairs = pairs.withColumn("word", F.substring_index("pair", " ", 1)).withColumn("after", F.substring_index("pair", " ", -1))
    initial = F.col("word").rlike(r"^\p{Lu}$")
    judged = pairs.join(short, F.lower("word") == F.col("_short"), "left").withColumn("known", initial | F.col("_short").isNotNull())
    known = judged.where("known").select("pair", "after", "times", initial.alias("initial"))
    starts = judged.where("NOT known").groupBy(F.col("after").alias("_after")).agg(F.sum("times").alias("_starts"))
    spelt = counts.where("low > 0 AND inside = 0").select(F.col("word").alias("_spelt"))
    begins = F.col("after").rlike(r"^\p{Lu}") & ~F.col("initial") & (F.col("_starts") >= F.col("times"))
    ends = known.join(starts, F.col("after") == F.col("_after")).where(begins).join(spelt, F.lower("after") == F.col("_spelt"), "left_semi")
    return known.select("pair").join(ends.select(F.col("pair").alias("_pair")), F.col("pair") == F.col("_pair"), "left_anti")


def learnt_sentences(pairs: DataFrame) -> Callable[[Column], Column] | None:
    """Boundaries for `split_sentences` and `segment` from pairs that go on, inside the plan; None where they are too many for that (see `with_sentences`)."""
    size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pair")), F.lit(0))).first()
    if size[0] > PLAN_PAIRS or size[1] > PLAN_BYTES:
        return None
    held = F.array(*[F.lit(r["pair"]) for r in pairs.collect()]).cast("array<string>")
    return lambda text: raw_by(text, held)


def raw_by(text: Column, held: Column) -> Column:
    """Cut behind . ! ? and blanks, but not between the words of a pair that goes on. held: array of pairs."""

    def joined(pieces: Column) -> Column:
        # a piece goes on where the pair of the piece before it and its own is known
        put = F.transform(pieces, lambda x, n: F.when((n > 0) & ~F.coalesce(F.array_contains(held, _pair(F.get(pieces, n - 1), x)), F.lit(False)), F.concat(F.lit(BREAK), x)).otherwise(x))
        return F.split(F.array_join(put, ""), BREAK)

    return F.filter(F.transform(let(_pieces(text), joined), strip), lambda x: x != "")


def with_sentences(texts: DataFrame, pairs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts (key, text, others) with `raw`, cut by pairs that go on, however many there are: a text's own pairs are looked up by a join, then its sentences are cut where it lies.

    Null and empty texts have none; key names a row.
    """
    own = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(pairs_of(F.col(text)))).alias("pair"))
    held = own.join(pairs, "pair").groupBy("_key").agg(F.collect_set("pair").alias("_held"))
    found = texts.join(held, texts[key] == held["_key"], "left")
    return found.withColumn("raw", raw_by(F.col(text), F.coalesce("_held", F.array().cast("array<string>")))).drop("_key", "_held")


#: For DuckDB, from the same patterns: ends <counts>, <short> and <going> for documents (doc_id, text).
def sql(prior: list[str] | tuple[str, ...] = ()) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    add = f" UNION SELECT unnest([{', '.join(quoted(w.lower()) for w in prior)}]) AS word" if prior else ""
    cut = f"string_split(regexp_replace(text, {quoted(CUT)}, '\\1' || chr(64977) || '\\2', 'g'), chr(64977))"
    return f"""
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(text, {quoted(BLANKS)}), lambda x: x <> '') AS l FROM texts),
tok AS (SELECT regexp_replace(l[n], {quoted(TRAIL)}, '') AS bare, CASE WHEN n > 1 THEN l[n - 1] END AS before FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM toks)),
occ AS (SELECT regexp_extract(bare, {quoted(WORD)}, 1) AS w, bare LIKE '%.' AS pointed, before FROM tok),
counts AS (SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (pointed) AS pointed, count(*) FILTER (regexp_matches(w, '^\\p{{Ll}}')) AS low,
  count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}') AND coalesce(NOT regexp_matches(before, '[.!?:][^\\p{{L}}0-9]*$'), false)) AS inside FROM occ GROUP BY lower(w)),
usual AS (SELECT least(greatest(sum(pointed)::DOUBLE / sum(n), 1e-9), 1 - 1e-9) AS p FROM counts),
shape AS (SELECT *, (n - pointed)::DOUBLE AS rest, length(word) - length(replace(word, '.', '')) AS points, length(replace(word, '.', ''))::DOUBLE AS letters FROM counts, usual WHERE word <> '' AND pointed > 0),
short AS (SELECT word, n, pointed, score FROM (SELECT *, 2 * ((pointed * ln({NEARLY_ALWAYS}) + rest * ln(1 - {NEARLY_ALWAYS}::DOUBLE)) - (pointed * ln(p) + rest * ln(1 - p))) * exp(-letters) * (points + 1) * pow(letters, -rest) AS score FROM shape) WHERE score >= {LEAST_SCORE}),
known AS (SELECT word FROM short{add}),
pieces AS (SELECT doc_id, p, n, regexp_extract(p[n], {quoted(POINTED)}, 1) AS word, regexp_extract(regexp_replace(p[n + 1], '^\\s+', ''), {quoted(NEXT)}, 1) AS after, n < len(p) AS more
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, {cut} AS p FROM texts))),
pairs AS (SELECT word, after, count(*) AS times, regexp_matches(word, '^\\p{{Lu}}$') AS initial, lower(word) IN (SELECT word FROM known) AS listed FROM pieces WHERE more AND word <> '' GROUP BY word, after),
starts AS (SELECT after, sum(times) AS starts FROM pairs WHERE NOT initial AND NOT listed GROUP BY after),
going AS (SELECT word, after FROM pairs LEFT JOIN starts USING (after) WHERE initial OR (listed AND NOT (regexp_matches(after, '^\\p{{Lu}}') AND coalesce(starts >= times, false)
    AND lower(after) IN (SELECT word FROM counts WHERE low > 0 AND inside = 0)))),
judged AS (SELECT doc_id, p[n] AS piece, n, coalesce(more AND (word, after) IN (SELECT (word, after) FROM going), false) AS goes_on FROM pieces)"""
