"""Model outputs: decoding of token labels to spans, confidences, counts, and the seam for a model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statutegrid.functions import patterns as P
from statutegrid.functions.ship import ship
from statutegrid.functions.text import let, strip

PREDICTION = (
    "struct<spans:array<struct<start:int,end:int,text:string>>,count:int,ordinal_count:int,aim_n_bucket:int,confidence:double>"
)


def argmax(logits: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)))


def argmax_tags(logits: Column) -> Column:
    return F.transform(logits, argmax)


def viterbi_tags(logits: Column, transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> Column:
    """Best labels of a sequence under transition scores (from, to); ties go to the lower label.

    One fold over the tokens; its state are the best score and path of each label.
    """
    n = len(transitions)
    begin, finish = start or [0.0] * n, end or [0.0] * n
    first = F.array(*[F.struct((logits[0][j] + F.lit(begin[j])).alias("score"), F.array(F.lit(j)).alias("path")) for j in range(n)])

    def best(options: list[Column]) -> Column:
        out = options[0]
        for o in options[1:]:
            out = F.when(o["score"] > out["score"], o).otherwise(out)
        return out

    def step(state: Column, token: Column) -> Column:
        def to(j: int) -> Column:
            won = best([F.struct((state[i]["score"] + F.lit(transitions[i][j])).alias("score"), state[i]["path"].alias("path")) for i in range(n)])
            return F.struct((won["score"] + token[j]).alias("score"), F.concat(won["path"], F.array(F.lit(j))).alias("path"))

        return F.array(*[to(j) for j in range(n)])

    rest = F.slice(logits, F.lit(2), F.greatest(F.size(logits) - 1, F.lit(0)))
    last = F.aggregate(rest, first, step)
    won = best([F.struct((last[j]["score"] + F.lit(finish[j])).alias("score"), last[j]["path"].alias("path")) for j in range(n)])
    return F.when(F.size(logits) > 0, won["path"]).otherwise(F.array().cast("array<int>"))


def bio_spans(tags: Column, offsets: Column, text: Column) -> Column:
    """array of (start, end, text). tags: 1 begins, 2 goes on or begins, 0 ends; offsets: array of (start, end), (0, 0) for special tokens, which end too.

    Tokens get the number of their span; blank fragments are dropped; a fragment is stripped, its offsets are not.
    """
    zipped = F.zip_with(
        tags, offsets, lambda tag, at: F.struct(F.when((at["start"] == 0) & (at["end"] == 0), 0).otherwise(tag).alias("tag"), at["start"].alias("start"), at["end"].alias("end"))
    )
    return let(zipped, lambda tokens: _spans(tokens, text))


def _spans(tokens: Column, text: Column) -> Column:

    def opens(i: Column) -> Column:
        return (tokens[i]["tag"] == 1) | ((tokens[i]["tag"] == 2) & ((i == 0) | (F.get(tokens, i - 1)["tag"] == 0)))

    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), opens)

    def span(at: Column) -> Column:
        after = F.slice(tokens, at + 2, F.greatest(F.size(tokens) - at - 1, F.lit(0)))
        stop = F.array_position(F.transform(after, lambda x: x["tag"] != 2), True)
        length = F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int")
        start, end = tokens[at]["start"], tokens[at + length]["end"]
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), strip(F.substr(text, start + 1, end - start)).alias("text"))

    return F.when(F.size(tokens) > 0, F.filter(F.transform(places, span), lambda s: s["text"] != "")).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def count_begins(tags: Column) -> Column:
    return F.size(F.filter(tags, lambda t: t == 1))


def ordinal_count(logits: Column) -> Column:
    return F.size(F.filter(logits, lambda x: 1 / (1 + F.exp(-x)) > 0.5))


def aim_bucket(count: Column) -> Column:
    return F.least(count, F.lit(P.BUCKET_CAP))


def mean_confidence(logits: Column, tags: Column, special: Column | None = None) -> Column:
    """Mean probability of the decoded labels over tokens that are not special; null without one."""
    flags = F.transform(tags, lambda t: F.lit(False)) if special is None else special
    labels = F.zip_with(logits, F.zip_with(tags, flags, lambda t, s: F.when(~s, t)), lambda token, t: F.struct(token.alias("token"), t.alias("t")))
    probs = F.transform(F.filter(labels, lambda x: x["t"].isNotNull()), lambda x: F.element_at(softmax(x["token"]), x["t"] + 1))
    return let(probs, lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)))


def prediction(logits: Column, offsets: Column, ordinals: Column, text: Column, transitions: list[list[float]] | None = None) -> Column:
    """All that is derived from a model's raw scores, at most MAX_TOKENS tokens."""
    logits, offsets = F.slice(logits, 1, P.MAX_TOKENS), F.slice(offsets, 1, P.MAX_TOKENS)
    tags = argmax_tags(logits) if transitions is None else viterbi_tags(logits, transitions)
    special = F.transform(offsets, lambda o: (o["start"] == 0) & (o["end"] == 0))
    spans = bio_spans(tags, offsets, text)
    return F.struct(
        spans.alias("spans"), F.size(spans).alias("count"), ordinal_count(ordinals).alias("ordinal_count"),
        aim_bucket(F.size(spans)).alias("aim_n_bucket"), mean_confidence(logits, tags, special).alias("confidence"),
    )


def with_predictions(segments: DataFrame, load: Callable[[], object]) -> DataFrame:
    """segments with prediction, by any object whose predict(text) has spans, count and confidence (predict_batch(texts) is preferred).

    load runs once in each Python worker and batch stream; texts come in Arrow batches.
    """

    @F.pandas_udf(T._parse_datatype_string(PREDICTION))  # type: ignore[call-overload]
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            found = model.predict_batch(list(texts)) if hasattr(model, "predict_batch") else [model.predict(t) for t in texts]
            rows = [
                ([{"start": s, "end": e, "text": t} for s, e, t in p.spans], p.count, getattr(p, "ordinal_count", None), getattr(p, "aim_n_bucket", min(p.count, P.BUCKET_CAP)), p.confidence)
                for p in found
            ]
            yield pd.DataFrame(rows, columns=["spans", "count", "ordinal_count", "aim_n_bucket", "confidence"]).astype({"confidence": "float64"})

    ship(segments.sparkSession)
    return segments.withColumn("prediction", predict(F.col("segment_text")))


@dataclass(frozen=True)
class Scorer:
    """A model that gives raw scores, made by load in each worker, and the transitions that its labels are decoded by: Viterbi with, arg-max without."""

    load: Callable[[], object]
    transitions: list[list[float]] | None = None


SCORES = "struct<logits:array<array<double>>,offsets:array<struct<start:int,end:int>>,ordinals:array<double>>"


def with_scores(segments: DataFrame, load: Callable[[], object], transitions: list[list[float]] | None = None) -> DataFrame:
    """segments with prediction, by any object whose scores(texts) has (logits, offsets, ordinals) for each text.

    Only the forward pass runs in Python, in batches; labels, spans, counts and confidences are worked out in Spark, by Viterbi where transitions are given.
    """

    @F.pandas_udf(T._parse_datatype_string(SCORES))  # type: ignore[call-overload]
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            rows = [(logits, [{"start": s, "end": e} for s, e in at], ordinals) for logits, at, ordinals in model.scores(list(texts))]
            yield pd.DataFrame(rows, columns=["logits", "offsets", "ordinals"])

    ship(segments.sparkSession)
    scored = segments.withColumn("_scores", score(F.col("segment_text")))
    found = prediction(F.col("_scores.logits"), F.col("_scores.offsets"), F.col("_scores.ordinals"), F.col("segment_text"), transitions)
    return scored.withColumn("prediction", found).drop("_scores")
