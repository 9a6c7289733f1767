"""Perplexity of a token-loss table `(pos, nll)` under several windowings.

The variants differ only in which window scores a position and how windows are
weighted. A position's window is arithmetic on `pos`, so no range join is needed; only
overlapping windows repeat a position, and their total needs just its repeat count.

The `windows_*` and `ppl_*` functions take any loss table, gaps included. For a corpus
under its own bigram counts every loss is known, so a position's share of the result is
a closed form (`weight_*`) and the whole variant is one weighted sum over bigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import as_column
from corpusgauge.session import materialise


def _window_means(placed: DataFrame, first: Column) -> DataFrame:
    """Mean loss per window over what it scores; NaN where it scores nothing.

    Positions are contiguous, so a window ends after its last position and the length of
    the whole sequence is not needed. A window's own first token has nothing before it
    to be predicted from.
    """
    nll = F.when(F.col("pos") > F.col("begin"), F.col("nll"))
    return (
        placed.groupBy("window", "begin")
        .agg(
            (F.max("pos") + 1).cast("bigint").alias("end"),
            F.count(nll).alias("labelled"),
            F.coalesce(F.avg(nll), F.lit(float("nan"))).alias("mean_nll"),
        )
        .withColumn("trg", F.col("end") - first)
    )


def windows_left(nll: DataFrame, stride: int = 512, max_len: int = 2048) -> DataFrame:
    """One row per stride of targets, whose context reaches back to fill `max_len`."""
    window = F.floor(F.col("pos") / stride).cast("bigint")
    begin = F.greatest(F.col("window") * stride + stride - max_len, F.lit(0)).cast("bigint")
    placed = nll.select("pos", "nll", window.alias("window")).withColumn("begin", begin)
    return _window_means(placed, F.col("window") * stride)


def windows_right(nll: DataFrame, stride: int = 512, max_len: int = 2048) -> DataFrame:
    """One row per window reaching right; it scores what the window before did not."""
    if stride <= max_len:
        window = F.when(F.col("pos") < max_len, F.lit(0)).otherwise(F.floor((F.col("pos") - max_len) / stride) + 1)
    else:
        window = F.floor(F.col("pos") / stride)
    placed = nll.select("pos", "nll", window.cast("bigint").alias("window"))
    placed = placed.withColumn("begin", F.col("window") * stride)
    # Positions between two windows that do not touch belong to neither.
    placed = placed.where(F.col("pos") < F.col("begin") + max_len)
    prev_end = F.when(F.col("window") > 0, (F.col("window") - 1) * stride + max_len).otherwise(F.lit(0))
    return _window_means(placed, prev_end)


def ppl_strided_left(nll: DataFrame, stride: int = 512, max_len: int = 2048) -> DataFrame:
    """Each window's mean counts once per target, scored or not."""
    w = windows_left(nll, stride, max_len)
    return w.agg(
        F.sum("trg").alias("n_tokens"), F.exp(F.sum(F.col("mean_nll") * F.col("trg")) / F.sum("trg")).alias("ppl")
    )


def ppl_strided_right(nll: DataFrame, stride: int = 512, max_len: int = 2048) -> DataFrame:
    """Each window's mean counts once per valid label less one."""
    w = windows_right(nll, stride, max_len)
    weight = F.least(F.col("trg"), F.col("end") - F.col("begin")) - 1
    return w.select("mean_nll", weight.alias("w")).agg(
        F.sum("w").alias("n_tokens"), F.exp(F.try_divide(F.sum(F.col("mean_nll") * F.col("w")), F.sum("w"))).alias("ppl")
    )


def _first_last(pos: Column, stride: int, ctx: int) -> tuple[Column, Column]:
    """First and last overlapping window that holds a position."""
    first = F.greatest(F.floor((pos - ctx) / stride) + 1, F.lit(0))
    return first.cast("bigint"), F.floor(pos / stride).cast("bigint")


def assign_windows(tokens: DataFrame, stride: int, ctx: int) -> DataFrame:
    """Each position with every overlapping window that holds it, ceil(ctx/stride) at most."""
    first, last = _first_last(F.col("pos"), stride, ctx)
    rows = tokens.withColumn("_f", first).withColumn("_l", last).where(F.col("_f") <= F.col("_l"))
    return rows.withColumn("window", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l")


def overlap_windows(nll: DataFrame, stride: int = 512, ctx: int = 2048) -> DataFrame:
    """`(window, trg, nll_sum)` of overlapping windows that score all they hold."""
    return (
        assign_windows(nll.select("pos", "nll"), stride, ctx)
        .groupBy("window")
        .agg(F.count("*").alias("trg"), F.sum("nll").alias("nll_sum"))
    )


def ppl_overlap(nll: DataFrame, stride: int = 512, ctx: int = 2048) -> DataFrame:
    """Overlapping windows, each scoring all its positions without a label shift.

    Equal to exp of the summed window losses over the summed window lengths; a position
    weighs as often as windows hold it, so nothing is repeated.
    """
    first, last = _first_last(F.col("pos"), stride, ctx)
    times = F.greatest(last - first + 1, F.lit(0))
    return nll.select("nll", times.alias("times")).agg(
        F.sum("times").alias("n_tokens"), F.exp(F.sum(F.col("nll") * F.col("times")) / F.sum("times")).alias("ppl")
    )


def ppl_single(nll: DataFrame) -> DataFrame:
    """exp of the mean loss over every scored position."""
    return nll.agg(F.count("nll").alias("n_tokens"), F.exp(F.avg("nll")).alias("ppl"))


def ppl_weighted(nll: DataFrame, weight: Column) -> DataFrame:
    """exp of the mean loss with a weight per position, `weight_*`; one without a loss adds its weight only."""
    weighted = nll.select("nll", weight.alias("w"))
    return _ppl(weighted.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("nll")).alias("loss")))


def weight_left(n: int, stride: int = 512, max_len: int = 2048) -> Column:
    """What a position counts for in `ppl_strided_left` of n tokens: targets over scored targets."""
    start = F.floor(F.col("pos") / stride) * stride
    begin = F.greatest(start + stride - max_len, F.lit(0))
    end = F.least(start + stride, F.lit(n))
    return _weight(end - start, end - F.greatest(start, begin + 1), begin)


def weight_right(n: int, stride: int = 512, max_len: int = 2048) -> Column:
    """The same for `ppl_strided_right`: valid labels less one over scored targets."""
    if stride <= max_len:
        window = F.when(F.col("pos") < max_len, F.lit(0)).otherwise(F.floor((F.col("pos") - max_len) / stride) + 1)
    else:
        window = F.floor(F.col("pos") / stride)
    begin = window * stride
    end = F.least(begin + max_len, F.lit(n))
    prev_end = F.when(window > 0, (window - 1) * stride + max_len).otherwise(F.lit(0))
    first = F.greatest(prev_end, begin)
    outside = F.col("pos") >= end
    return F.when(outside, F.lit(0.0)).otherwise(
        _weight(end - first - 1, end - F.greatest(first, begin + 1), begin)
    )


def _weight(counted: Column, scored: Column, begin: Column) -> Column:
    """NaN for a window that scores nothing, 0 for a window's own first token."""
    ratio = counted.cast("double") / F.greatest(scored, F.lit(1))
    return F.when(scored <= 0, F.lit(float("nan"))).when(F.col("pos") <= begin, F.lit(0.0)).otherwise(ratio)


def weight_overlap(stride: int = 512, ctx: int = 2048) -> Column:
    """The same for `ppl_overlap`: how many windows hold the position."""
    first, last = _first_last(F.col("pos"), stride, ctx)
    return F.greatest(last - first + 1, F.lit(0)).cast("double")


def weigh_bigrams(stream: DataFrame, weight: Column) -> DataFrame:
    """`(prev, token, n, w)`: occurrences and total weight per bigram, in one pass over the text.

    A loss hangs on its bigram alone, so positions need no join with the model and only
    bigram totals, combined map-side, are shuffled. Written out, as three readers follow.
    """
    types = stream.groupBy("prev", "token").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    return materialise(types)


def ppl_bigrams(types: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Perplexity of a text under the add-alpha bigram model of its own counts.

    The loss is ln(context total) - ln(count), so its weighted sum splits into one sum
    over bigrams and one over contexts, and the two never have to be joined.
    """
    vocab = types.agg(F.count_distinct("token")).first()[0]
    known = types.where(F.col("prev").isNotNull())
    pairs = _log_sum(known, F.lit(alpha))
    contexts = known.groupBy("prev").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    total = _log_sum(contexts, F.lit(alpha * vocab))
    return _ppl(types.agg(F.sum("w").alias("w")).select("w", (total - pairs).alias("loss")))


def _log_sum(df: DataFrame, add: Column) -> Column:
    """Sum of w * ln(n + add). Weights of equal counts are added first: few terms, little rounding."""
    by_count = df.groupBy("n").agg(F.sum("w").alias("w"))
    return by_count.agg(F.sum(F.col("w") * F.ln(F.col("n") + add))).scalar()


def ppl_own_token(types: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Unshifted scoring: each position is asked for its own token, given that token.

    Every bigram adds its weight to its token, and its count to its context; both meet in
    one grouping by word.
    """
    vocab = types.agg(F.count_distinct("token")).first()[0]
    same = F.when(F.col("prev") == F.col("token"), F.col("n")).otherwise(0)
    parts = F.array(
        F.struct(F.col("token").alias("word"), F.col("w"), F.lit(0).cast("bigint").alias("ctx"), F.lit(0).cast("bigint").alias("own")),
        F.struct(F.col("prev").alias("word"), F.lit(0.0).alias("w"), F.col("n").alias("ctx"), same.cast("bigint").alias("own")),
    )
    words = (
        types.select(F.inline(parts))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.sum("w").alias("w"), F.sum("ctx").alias("ctx"), F.sum("own").alias("own"))
    )
    loss = F.ln(F.col("ctx") + alpha * vocab) - F.ln(F.col("own") + alpha)
    # Words with equal counts lose equally; adding their weights first also keeps rounding down.
    alike = words.groupBy("ctx", "own").agg(F.sum("w").alias("w"))
    return _ppl(alike.agg(F.sum("w").alias("w"), F.sum(F.col("w") * loss).alias("loss")))


def _ppl(sums: DataFrame) -> DataFrame:
    return sums.select(
        F.when(~F.isnan("w"), F.round("w").cast("bigint")).alias("n_tokens"),
        F.exp(F.try_divide("loss", "w")).alias("ppl"),
    )


def sample_ppl(nll: DataFrame, by: str, prompt_len: Column | str | None = None) -> DataFrame:
    """`(by, n_labels, ppl)`: per-sample perplexity, prompt positions ignored if given."""
    kept = F.col("nll") if prompt_len is None else F.when(F.col("pos") >= as_column(prompt_len), F.col("nll"))
    return nll.groupBy(by).agg(
        F.count(kept).alias("n_labels"), F.exp(F.coalesce(F.avg(kept), F.lit(float("nan")))).alias("ppl")
    )


def ppl_conditional(
    nll: DataFrame, samples: DataFrame, by: str = "sample_id", prompt_len: str = "prompt_len", keep_skipped: bool = True
) -> DataFrame:
    """Mean of per-sample perplexities with the prompt masked.

    `samples` lists every sample, skipped ones too; by default these still count in the
    mean's denominator.
    """
    per_sample = sample_ppl(nll, by, prompt_len)
    total = samples.agg(F.count("*")).scalar()
    rows = total if keep_skipped else F.count("*")
    return per_sample.agg(
        F.count("*").alias("n_scored"), F.try_divide(F.sum("ppl"), rows.cast("double")).alias("ppl")
    )


def ppl_continuation(nll: DataFrame, by: str) -> DataFrame:
    """Perplexity of each generated continuation scored as a sequence of its own."""
    return sample_ppl(nll, by)
