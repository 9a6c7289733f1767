"""Interpolated back-off n-gram model with absolute discounts taken from counts of counts.

The longest context counts occurrences. A shorter one counts continuations: how many different words
stood before it. Each level takes a discount off every count and hands what it took to the level
below, down to single words, which hand theirs to a uniform share over the vocabulary and one place
for any unknown word. So the probabilities of every context, seen or not, add up to one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.operators.joins import may_hash, measured
from corpusgauge.operators.ngram import attach_nll
from corpusgauge.session import materialise

LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.9  # when too few n-grams occur once or twice to tell


@dataclass
class Level:
    """One context length: `grams` (context.., token, n), `totals` (context.., total, kinds) and the discount."""

    context: list[str]
    grams: DataFrame
    totals: DataFrame
    discount: float


@dataclass
class Backoff:
    levels: list[Level]  # single words first
    vocab: int

    @property
    def context(self) -> list[str]:
        return self.levels[-1].context


def discount(grams: DataFrame) -> float:
    """n1 / (n1 + 2 n2) of the n-grams counted once and twice, within bounds."""
    once, twice = grams.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    share = once / (once + 2 * twice) if once else 0.0
    return min(max(share, LEAST_DISCOUNT), MOST_DISCOUNT)


def fit_backoff(counts: DataFrame, context: Sequence[str] = ("prev",)) -> Backoff:
    """Model of `(context.., token, n)`, as `ngram.count_ngrams` gives; the nearest word leads the context.

    N-grams whose context is unknown (null) count for no level; the vocabulary is every token counted.
    """
    vocab = counts.agg(F.count_distinct("token")).first()[0]
    names, levels = list(context), []
    grams = counts.dropna(subset=names).select(*names, "token", "n") if names else counts.select("token", "n")  # stored
    while True:
        sums = [F.sum("n").alias("total"), F.count("*").alias("kinds")]
        totals = materialise(grams.groupBy(*names).agg(*sums) if names else grams.agg(*sums).where("kinds > 0"))
        levels.insert(0, Level(list(names), grams, totals, discount(grams)))
        if not names:
            return Backoff(levels, vocab)
        names = names[:-1]  # without the farthest word, each different one of which counts once
        grams = materialise(grams.groupBy(*names, "token").agg(F.count("*").alias("n")))


def probabilities(types: DataFrame, model: Backoff) -> DataFrame:
    """`(context.., token, p)` for distinct n-grams of any text, seen by the model or not.

    Level by level from single words up; each level joins distinct n-grams, so no table is larger
    than the n-grams asked for, and adaptive execution splits a context that very many of them have.
    """
    small = measured(types)[2]
    lower = None
    for level in model.levels:
        keys = types.select(*level.context, "token").distinct()
        grams, totals = level.grams, level.totals
        if small:  # only the model's rows that are asked for are shuffled and sorted
            grams = grams.join(F.broadcast(keys), [*level.context, "token"], "left_semi")
            if level.context:
                totals = totals.join(F.broadcast(keys.select(*level.context).distinct()), level.context, "left_semi")
        found = keys.join(grams, [*level.context, "token"], "left")
        lower = materialise(_level(found, level, totals, lower, model.vocab))
    return lower


def own_probabilities(model: Backoff) -> DataFrame:
    """`(context.., token, n, p)` for the n-grams that the model was fitted on.

    Their counts are known and they are distinct, so a level meets its totals and the level below,
    and neither itself nor what was asked for. The longest level is not written out.
    """
    found = None
    for level in model.levels:
        lower = None if found is None else materialise(found.drop("n"))
        totals = _hashed(level.totals) if level.context else level.totals
        found = _level(level.grams, level, totals, lower and _hashed(lower), model.vocab, "n")
    return found


def _level(found: DataFrame, level: Level, totals: DataFrame, lower: DataFrame | None, vocab: int, *kept: str) -> DataFrame:
    """Probabilities of one level's n-grams, whose `n` is null for one it lacks, from those of the level below."""
    known = F.lit(1.0 / (vocab + 1))
    found = found.join(totals, level.context, "left") if level.context else _with_total(found, totals)
    if lower is not None:
        found = found.join(lower.withColumnRenamed("p", "_below"), [*level.context[:-1], "token"])
        known = F.col("_below")
    return found.select(*level.context, "token", *kept, _share(level.discount, known).alias("p"))


def _hashed(stored: DataFrame) -> DataFrame:
    """A stored table of distinct keys, hashed in memory if a task's part of it fits, which spares sorting the n-grams it meets."""
    return stored.hint("shuffle_hash") if may_hash(stored.sparkSession, stored.count()) else stored


def _with_total(found: DataFrame, totals: DataFrame) -> DataFrame:
    row = totals.first()  # single words have one total
    total, kinds = (row["total"], row["kinds"]) if row else (None, None)
    return found.withColumns({"total": F.lit(total).cast("bigint"), "kinds": F.lit(kinds).cast("bigint")})


def _share(taken: float, below: Column) -> Column:
    own = F.greatest(F.coalesce("n", F.lit(0)) - F.lit(taken), F.lit(0.0)) / F.col("total")
    return F.when(F.col("total").isNull(), below).otherwise(own + F.lit(taken) * F.col("kinds") / F.col("total") * below)


def score_types(types: DataFrame, model: Backoff) -> DataFrame:
    """`(context.., token, n, nll)` for counted n-grams, in the form `ngram.attach_nll` takes."""
    stored = materialise(types)
    found = probabilities(stored, model)
    return stored.join(found, [*model.context, "token"]).select(*model.context, "token", "n", (-F.ln("p")).alias("nll"))


def score_backoff(stream: DataFrame, model: Backoff, salt: Sequence[str]) -> DataFrame:
    """Token losses of a text, worked out per distinct n-gram; null where the context is unknown."""
    names = model.context
    types = stream.dropna(subset=names).groupBy(*names, "token").agg(F.count("*").alias("n"))
    return attach_nll(stream, score_types(types, model), salt)
