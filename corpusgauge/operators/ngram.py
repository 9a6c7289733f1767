"""Count-based n-gram language model: the source of token losses and predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import arrays as A
from corpusgauge.functions import text as X
from corpusgauge.operators.joins import attach_narrow, is_small, lookup, measured
from corpusgauge.operators.ordering import key_range, last_before, range_bits, running_offset
from corpusgauge.operators.rows import corpus_tokens
from corpusgauge.session import materialise


def explode_tokens(df: DataFrame, tokens: str = "tokens", order: int = 2, start: Column | None = None) -> DataFrame:
    """`(.., pos, prev.., token)`: each token with the order-1 tokens before it.

    `prev` is the nearest, `prev2` the one before. `start` stands before the first
    token; null means nothing is known there.
    """
    keep = [c for c in df.columns if c != tokens]
    opening = start if start is not None else F.lit(None).cast("string")
    back = [A.previous(tokens, opening, k).alias(f"prev{k if k > 1 else ''}") for k in range(1, order)]
    zipped = df.select(*keep, F.col(tokens).alias("token"), *back)
    fields = ["token", *[f"prev{k if k > 1 else ''}" for k in range(1, order)]]
    exploded = zipped.select(*keep, F.posexplode(F.arrays_zip(*fields)).alias("pos", "_t"))
    return exploded.select(*keep, "pos", *[F.col("_t")[f].alias(f) for f in fields])


def row_tokens(df: DataFrame, key: str, col: str = "text", order: int = 2) -> DataFrame:
    """Tokens with contexts that stay within each row."""
    return explode_tokens(df.select(key, X.words(col).alias("tokens")), order=order)


def corpus_stream(
    df: DataFrame,
    key: str,
    col: str = "text",
    separator: str = "\n\n",
    bos: str | None = None,
    bounds: tuple[int, int] | None = None,
) -> tuple[DataFrame, int]:
    """`(key, pos, token, prev)` over the joined corpus, and its length; `pos` counts from its start.

    A row after the first is preceded by the separator. One of spaces is no token, so there
    the last word of the nearest row that has one stands before the row.
    """
    bounds = bounds or key_range(df, key)
    tokens = corpus_tokens(df, key, col, separator, bos, bounds)
    # Only the sizes are ordered and added up, not the tokens.
    sizes = materialise(tokens.select(key, F.size("tokens").cast("bigint").alias("n"), F.get("tokens", F.size("tokens") - 1).alias("_last")))
    rows, length = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    offsets = running_offset(sizes.select(key, "n"), key, "n", "offset", range_bits(*bounds)).select(key, "offset")
    placed = attach_narrow(tokens, offsets, key, rows)
    if _is_token(separator):
        start = _opening(key, separator, bounds)
    else:
        placed, start = _after_last(placed, sizes, key, rows, bounds)
    exploded = explode_tokens(placed, start=start)
    return exploded.withColumn("pos", F.col("offset") + F.col("pos")).drop("offset", "_opens"), length


def _is_token(separator: str) -> bool:
    return bool(separator.strip(" "))


def _after_last(
    tokens: DataFrame, lasts: DataFrame, key: str, rows: int, bounds: tuple[int, int]
) -> tuple[DataFrame, Column]:
    """`tokens` with the word that stands before each row when rows are joined by spaces."""
    before = last_before(lasts.select(key, "_last"), key, "_last", "_opens", range_bits(*bounds))
    return attach_narrow(tokens, before.select(key, "_opens"), key, rows), F.col("_opens")


def _opening(key: str, separator: str, bounds: tuple[int, int]) -> Column:
    """What stands before a row's first token: the separator, nothing for the first row."""
    return F.when(F.col(key) > F.lit(bounds[0]), F.lit(separator))


def corpus_bag(
    df: DataFrame,
    key: str,
    col: str = "text",
    separator: str = "\n\n",
    bos: str | None = None,
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """The joined corpus without global positions, enough for counting n-grams."""
    bounds = bounds or key_range(df, key)
    tokens = corpus_tokens(df, key, col, separator, bos, bounds)
    if _is_token(separator):
        return explode_tokens(tokens, start=_opening(key, separator, bounds))
    lasts = materialise(tokens.select(key, F.get("tokens", F.size("tokens") - 1).alias("_last")))
    placed, start = _after_last(tokens, lasts, key, lasts.count(), bounds)
    return explode_tokens(placed, start=start).drop("_opens")


def count_ngrams(stream: DataFrame, context: Sequence[str] = ("prev",)) -> DataFrame:
    """`(context.., token, n)`, unknown (null) contexts included, written out once.

    The one pass over the text; models of this and lower orders are read off it.
    """
    return materialise(stream.groupBy(*context, "token").agg(F.count("*").alias("n")))


def marginal(counts: DataFrame, context: Sequence[str]) -> DataFrame:
    """Counts of a shorter context."""
    return counts.groupBy(*context, "token").agg(F.sum("n").alias("n"))


def model_from_counts(counts: DataFrame, context: Sequence[str] = ("prev",)) -> DataFrame:
    """`(context.., token, n, ctx_n, vocab)` with the vocabulary size of everything counted."""
    words = counts.groupBy("token").agg(F.octet_length("token").alias("size"))
    size, weight = words.agg(F.count("token"), F.coalesce(F.sum("size"), F.lit(0))).first()
    vocab = F.lit(size)
    known = counts.dropna(subset=list(context)) if context else counts
    if not context:
        total = known.agg(F.sum("n")).first()[0] or 0
        return known.select("token", "n", F.lit(total).alias("ctx_n"), vocab.alias("vocab"))
    totals = known.groupBy(*context).agg(F.sum("n").alias("ctx_n"))
    # A one-word context is a word of the vocabulary, whose size was just measured. A big
    # one meets its n-grams in a shuffle of distinct n-grams, where adaptive execution
    # splits a context that owns very many of them.
    if len(context) == 1 and is_small(counts.sparkSession, size, weight):
        totals = F.broadcast(totals)
    return known.join(totals, list(context)).select(*context, "token", "n", "ctx_n", vocab.alias("vocab"))


def fit_ngram(stream: DataFrame, context: Sequence[str] = ("prev",)) -> DataFrame:
    return model_from_counts(count_ngrams(stream, context), context)


def smoothed_nll(n: Column, ctx_n: Column, vocab: Column, alpha: float) -> Column:
    return -F.ln((n + alpha) / (ctx_n + alpha * vocab))


def _context(model: DataFrame) -> list[str]:
    return [c for c in model.columns if c.startswith("prev")]


def seen_nll(model: DataFrame, alpha: float = 1.0) -> DataFrame:
    """`(context.., token, n, nll)` for the model's own n-grams."""
    nll = smoothed_nll(F.col("n"), F.col("ctx_n"), F.col("vocab"), alpha)
    return model.select(*_context(model), "token", "n", nll.alias("nll"))


def score_types(types: DataFrame, model: DataFrame, alpha: float = 1.0) -> DataFrame:
    """`(context.., token, n, nll)` for n-grams counted in any text, seen by the model or not."""
    context = _context(model)
    known = materialise(model)
    grams = known.select(*context, "token", F.col("n").alias("_n"))
    size, total = known.agg(F.max("vocab"), F.max("ctx_n")).first()
    found = types.join(grams, [*context, "token"], "left")
    if context:
        totals = known.groupBy(*context).agg(F.max("ctx_n").alias("ctx_n"))
        found = found.join(totals, context, "left")
    else:
        found = found.withColumn("ctx_n", F.lit(total))
    zero = F.lit(0)
    nll = smoothed_nll(F.coalesce("_n", zero), F.coalesce("ctx_n", zero), F.lit(size), alpha)
    return found.select(*context, "token", "n", nll.alias("nll"))


def attach_nll(stream: DataFrame, scored: DataFrame, salt: Sequence[str]) -> DataFrame:
    """The stream with its `nll`; null where the context is unknown."""
    return lookup(stream, scored, [*_context(scored), "token"], "n", list(salt))


def score_ngram(stream: DataFrame, model: DataFrame, salt: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Token losses of a text under a model fitted on any text.

    Losses are worked out once per distinct n-gram and then joined to the positions.
    """
    context = _context(model)
    known = stream.dropna(subset=context) if context else stream
    types = known.groupBy(*context, "token").agg(F.count("*").alias("n"))
    return attach_nll(stream, score_types(types, model, alpha), salt)


def score_counted(stream: DataFrame, counts: DataFrame, salt: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """`score_ngram` under the bigram model of stored counts, which is built for the text's bigrams only."""
    types = materialise(stream.dropna(subset=["prev"]).groupBy("prev", "token").agg(F.count("*").alias("n")))
    vocab = counts.agg(F.count_distinct("token")).first()[0]
    words = types.select("prev").distinct()
    totals = counts.join(words, "prev", "left_semi").groupBy("prev").agg(F.sum("n").alias("ctx_n"))
    grams = counts.withColumnRenamed("n", "_n").join(types.select("prev", "token"), ["prev", "token"], "left_semi")
    found = types.join(grams, ["prev", "token"], "left").join(totals, "prev", "left")
    zero = F.lit(0)
    nll = smoothed_nll(F.coalesce("_n", zero), F.coalesce("ctx_n", zero), F.lit(vocab), alpha)
    return attach_nll(stream, found.select("prev", "token", "n", nll.alias("nll")), salt)


def best_next(model: DataFrame, name: str = "best") -> DataFrame:
    """`(context.., best)`: the most frequent successor; the smaller token wins a tie."""
    context = _context(model)
    known = model.dropna(subset=context)
    first = F.min(F.struct((-F.col("n")).alias("neg"), F.col("token").alias("token")))
    return known.groupBy(*context).agg(first.alias("_first")).select(*context, F.col("_first.token").alias(name))


def greedy_completion(prompts: DataFrame, best: DataFrame, key: str, last: str, max_tokens: int = 1) -> DataFrame:
    """Most likely continuation of each prompt's last token, up to `max_tokens` long.

    Chains grow per distinct last token, not per prompt, and stop where nothing follows. They
    soon run into the same few words; `lookup` spreads those, and each step is written out.
    """
    steps = materialise(best.select(F.col("prev").alias("_at"), F.col("best").alias("_next")))
    size = measured(steps)
    return _complete(prompts, key, last, max_tokens, lambda _: (steps, size))


def greedy_counted(prompts: DataFrame, counts: DataFrame, key: str, last: str, max_tokens: int = 1) -> DataFrame:
    """`greedy_completion` over stored bigram counts: a step ranks the successors of the words it starts from only."""

    def follow(chains: DataFrame) -> tuple[DataFrame, tuple[int, int, bool]]:
        wanted = materialise(chains.select(F.col("_at").alias("prev")).distinct())
        best = best_next(counts.join(wanted, "prev", "left_semi"))
        steps = materialise(best.select(F.col("prev").alias("_at"), F.col("best").alias("_next")))
        return steps, measured(steps)

    return _complete(prompts, key, last, max_tokens, follow)


def _complete(
    prompts: DataFrame, key: str, last: str, max_tokens: int, follow: Callable[[DataFrame], tuple[DataFrame, tuple[int, int, bool]]]
) -> DataFrame:
    """Chains of words, each step by the stored table `(_at, _next)` and its size that `follow` gives for them."""
    starts = prompts.where(F.col(last).isNotNull()).groupBy(F.col(last).alias("_start")).agg(
        F.count("*").alias("_rows")
    )
    chains = starts.select("_start", "_rows", F.col("_start").alias("_at"), F.array().cast("array<string>").alias("_out"))
    for _ in range(max_tokens):
        steps, size = follow(chains)
        chains = materialise(lookup(chains, steps, ["_at"], None, ["_start"], stored=True, size=size)).select(
            "_start",
            "_rows",
            F.col("_next").alias("_at"),
            F.when(F.col("_next").isNull(), F.col("_out")).otherwise(F.concat("_out", F.array("_next"))).alias("_out"),
        )
    done = chains.select(
        F.col("_start").alias(last), "_rows", F.col("_out").alias("_words")
    )
    out = lookup(prompts, done, [last], "_rows", [key])
    return out.withColumn("completion", F.coalesce(F.array_join("_words", " "), F.lit(""))).withColumn(
        "n_tokens", F.coalesce(F.size("_words"), F.lit(0))
    ).drop("_words")
