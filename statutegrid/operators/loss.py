"""The loss of tagged and counted sentences as one aggregation: conditional random field or cross entropy, balanced thresholds, the penalty of sentences without an aim.

A row's part is a fold over its tokens; what the balance needs of all rows (how many are beyond each threshold) is summed beside the parts, so each batch is one group of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutegrid.functions.text import let

#: Weights of the parts, the most that a rare threshold weighs.
ORDINAL_WEIGHT, NO_AIM_WEIGHT, MOST_WEIGHT = 0.3, 0.5, 50.0


def log_sum_exp(values: list[Column]) -> Column:
    return let(F.greatest(*values), lambda top: top + F.log(sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top))))


def log_partition(logits: Column, transitions: Sequence[Sequence[float]], start: Sequence[float] | None = None, end: Sequence[float] | None = None) -> Column:
    """Log of the sum over all labellings of exp(score): the forward recursion, one fold over the tokens. 0 of no tokens."""
    n = len(transitions)
    begin, finish = start or [0.0] * n, end or [0.0] * n
    first = F.array(*[logits[0][j] + F.lit(begin[j]) for j in range(n)])

    def step(state: Column, token: Column) -> Column:
        return F.array(*[log_sum_exp([state[i] + F.lit(transitions[i][j]) for i in range(n)]) + token[j] for j in range(n)])

    rest = F.slice(logits, F.lit(2), F.greatest(F.size(logits) - 1, F.lit(0)))
    last = let(F.aggregate(rest, first, step), lambda s: log_sum_exp([s[j] + F.lit(finish[j]) for j in range(n)]))
    return F.when(F.size(logits) > 0, last).otherwise(0.0)


def path_score(logits: Column, labels: Column, transitions: Sequence[Sequence[float]], start: Sequence[float] | None = None, end: Sequence[float] | None = None) -> Column:
    """Score of one labelling: its logits, and the transitions between its labels."""
    n = len(transitions)
    begin, finish = (F.array(*[F.lit(float(x)) for x in v or [0.0] * n]) for v in (start, end))
    moves = F.array(*[F.lit(float(x)) for row in transitions for x in row])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    own = total(F.zip_with(logits, labels, lambda x, y: F.get(x, y)))
    pairs = F.zip_with(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda a, b: F.get(moves, a * n + b))
    return F.when(F.size(labels) > 0, own + total(pairs) + F.get(begin, F.get(labels, F.lit(0))) + F.get(finish, F.get(labels, F.size(labels) - 1))).otherwise(0.0)


def _soft_plus(x: Column) -> Column:
    """ln(1 + exp(x)), for x of any size."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def losses(
    rows: DataFrame, batch: str, transitions: Sequence[Sequence[float]] | None, start: Sequence[float] | None = None, end: Sequence[float] | None = None,
    ordinal_weight: float = ORDINAL_WEIGHT, no_aim_weight: float = NO_AIM_WEIGHT,
) -> DataFrame:
    """(batch, n, span_loss, ordinal_loss, penalty, loss) of rows (batch, logits, labels, ordinal_logits, ordinal_labels, aim_n).

    Tokens with a negative label are left out. With transitions the span loss is the mean negative log likelihood of a row's labels, without it is the cross entropy
    of all labelled tokens. penalty: the sum of what speaks for labels 1 and 2 in rows of aim_n 0, by their number of tokens; null without such rows.
    A null aim_n is no 0; rows without labelled tokens count with 0; a threshold weighs its positive rows by negative over positive ones, at most MOST_WEIGHT times.
    """
    kept = F.filter(F.arrays_zip(F.col("logits").alias("x"), F.col("labels").alias("y")), lambda t: t["y"] >= 0)
    width = 3
    sums = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def span_part(tokens: Column) -> Column:
        x, y = F.transform(tokens, lambda t: t["x"]), F.transform(tokens, lambda t: t["y"])
        if transitions is not None:
            return log_partition(x, transitions, start, end) - path_score(x, y, transitions, start, end)
        return sums(F.transform(tokens, lambda t: log_sum_exp([t["x"][j] for j in range(width)]) - F.get(t["x"], t["y"])))

    none = F.coalesce(F.col("aim_n") == 0, F.lit(False))
    speaks = sums(F.transform("logits", lambda x: x[1] + x[2]))
    each = lambda name, j: F.col(name)[j].cast("double")
    parts = rows.withColumn("_tokens", kept).select(
        F.col(batch), let(F.col("_tokens"), span_part).alias("_span"), F.size("_tokens").alias("_labelled"), none.alias("_none"), F.when(none, speaks).alias("_speaks"), F.when(none, F.size("logits")).alias("_tokens"),
        *[each("ordinal_labels", j).alias(f"_y{j}") for j in range(width)],
        *[(each("ordinal_labels", j) * _soft_plus(-each("ordinal_logits", j))).alias(f"_p{j}") for j in range(width)],
        *[((1 - each("ordinal_labels", j)) * _soft_plus(each("ordinal_logits", j))).alias(f"_n{j}") for j in range(width)],
    )
    summed = parts.groupBy(batch).agg(
        F.count("*").alias("n"), F.sum("_span").alias("_span"), F.sum("_labelled").alias("_labelled"), F.max("_none").alias("_none"), F.sum("_speaks").alias("_speaks"), F.sum("_tokens").alias("_tokens"),
        *[F.sum(f"_{k}{j}").alias(f"_{k}{j}") for k in "ypn" for j in range(width)],
    )
    weight = lambda j: F.least(F.greatest(F.col("n") - F.greatest(F.col(f"_y{j}"), F.lit(1.0)), F.lit(1.0)) / F.greatest(F.col(f"_y{j}"), F.lit(1.0)), F.lit(MOST_WEIGHT))
    ordinal = sum((weight(j) * F.col(f"_p{j}") + F.col(f"_n{j}") for j in range(1, width)), weight(0) * F.col("_p0") + F.col("_n0")) / (width * F.col("n"))
    span = F.col("_span") / (F.col("n") if transitions is not None else F.greatest(F.col("_labelled"), F.lit(1)))
    penalty = F.when(F.col("_none"), F.col("_speaks") / F.greatest(F.col("_tokens"), F.lit(1)))
    found = summed.select(batch, "n", span.alias("span_loss"), ordinal.alias("ordinal_loss"), penalty.alias("penalty"))
    return found.withColumn("loss", F.col("span_loss") + ordinal_weight * F.col("ordinal_loss") + no_aim_weight * F.coalesce("penalty", F.lit(0.0)))
