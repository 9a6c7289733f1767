"""Latency, throughput and speed-up of generation logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import per_second, per_token
from corpusgauge.functions.text import as_column
from corpusgauge.operators.joins import null_safe_join
from corpusgauge.operators.quantiles import exact_percentiles


def latency(df: DataFrame, n: str = "n_tokens", t: str = "elapsed_s") -> DataFrame:
    """Seconds per token and tokens per second on the tokens really generated; empty ones drop out."""
    return df.where(F.col(n) > 0).withColumn("latency", per_token(t, n)).withColumn("throughput", per_second(n, t))


def latency_assumed(df: DataFrame, budget: int, t: str = "elapsed_s") -> DataFrame:
    """The same on the token budget asked for."""
    tokens = F.lit(float(budget))
    return df.withColumn("latency", per_token(t, tokens)).withColumn("throughput", per_second(tokens, t))


def average(
    df: DataFrame,
    kind: str = "micro",
    by: Sequence[str] = (),
    n: str = "n_tokens",
    t: str = "elapsed_s",
    kept: Column | None = None,
    batch: str = "batch_size",
) -> DataFrame:
    """Average latency and throughput.

    micro: total time over total tokens. macro: mean of per-sample ratios. macro_full:
    ratios of kept samples over the count of all samples. batch_weighted: ratios of a
    batch weighted by its size.
    """
    tokens, seconds = F.col(n).cast("double"), F.col(t)
    lat, thr = per_token(seconds, tokens), per_second(tokens, seconds)
    if kind == "micro":
        pair = per_token(F.sum(seconds), F.sum(tokens)), per_second(F.sum(tokens), F.sum(seconds))
        rows = df.where(F.col(n) > 0)
    elif kind == "macro":
        pair = F.avg(lat), F.avg(thr)
        rows = df.where(F.col(n) > 0)
    elif kind == "macro_full":
        ok = kept if kept is not None else F.col(n) > 0
        pair = tuple(F.sum(F.when(ok, x)) / F.count("*") for x in (lat, thr))
        rows = df
    elif kind == "batch_weighted":
        pair = tuple(F.sum(x * F.col(batch)) / F.sum(batch) for x in (lat, thr))
        rows = df
    else:
        raise ValueError(f"unknown average {kind!r}")
    aggregates = [F.count("*").alias("samples"), pair[0].alias("latency"), pair[1].alias("throughput")]
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def rollup_runs(df: DataFrame, by: str | Sequence[str] = "run_id", counters: Sequence[str] = ("accepted", "rejected", "rollbacks")) -> DataFrame:
    """Sample counters, as `speculation.acceptance` names them, summed up to their run."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def mode_totals(df: DataFrame, by: Sequence[str], n: str = "n_tokens", t: str = "elapsed_s") -> DataFrame:
    return df.where(F.col(n) > 0).groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum(n).alias("tokens"), F.sum(t).alias("seconds")
    )


def pair_runs(
    df: DataFrame, key: str = "prompt_id", baseline: str = "baseline", assisted: str = "assisted", mode: str = "mode"
) -> DataFrame:
    """Baseline and assisted totals of the same prompt, side by side; unpaired prompts drop out.

    Prompts are totalled first, so both sides are unique by prompt and a hot prompt has
    already been combined map-side.
    """
    totals = mode_totals(df, [key, mode])

    def side(name: str, tag: str) -> DataFrame:
        return totals.where(F.col(mode) == name).select(
            key, F.col("tokens").alias(f"{tag}_tokens"), F.col("seconds").alias(f"{tag}_seconds")
        )

    return side(baseline, "baseline").join(side(assisted, "assisted"), key)


def speedup(
    df: DataFrame,
    baseline: str = "baseline",
    assisted: str = "assisted",
    by: Sequence[str] = (),
    mode: str = "mode",
    n: str = "n_tokens",
    t: str = "elapsed_s",
) -> DataFrame:
    """Micro latency of the baseline over that of the assisted mode, in one pass."""
    rows = df.where((F.col(n) > 0) & F.col(mode).isin(baseline, assisted))

    def micro(name: str) -> Column:
        only = F.col(mode) == name
        return F.try_divide(F.sum(F.when(only, F.col(t))), F.sum(F.when(only, F.col(n).cast("double"))))

    aggregates = [micro(baseline).alias("baseline_latency"), micro(assisted).alias("assisted_latency")]
    out = rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)
    return out.withColumn("speedup", F.try_divide("baseline_latency", "assisted_latency"))


def step_latencies(df: DataFrame, by: Sequence[str] = ("run_id",), ms: str = "ms") -> DataFrame:
    """Steps, mean, exact median and 95th percentile per run.

    The steps themselves stay rows of the table, in `step` order, rather than one list
    per run. A run without any latency stays, with 0 steps; a null run is a run.
    """
    keys = list(by)
    totals = df.groupBy(*keys).agg(F.count(ms).alias("steps"), F.avg(ms).alias("mean_ms"))
    marks = exact_percentiles(df, keys, ms, {"p50_ms": 0.5, "p95_ms": 0.95})
    return null_safe_join(totals, marks, keys, "left")


def speed_ratio(throughput: Column | str, baseline: float) -> Column:
    """Speed-up read off throughputs."""
    return as_column(throughput) / F.lit(baseline)
