"""Hooks for a caller's own functions, run on Arrow batches inside Spark's partitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.operators.joins import expand_samples


MOST_RESULTS = 10_000


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None
) -> DataFrame:
    """Apply a batch function; `workers` sets the number of partitions when given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    spread = df.repartition(workers) if workers else df
    return spread.mapInPandas(run, schema)


def prepare_scores(df: DataFrame, fn: Callable[[Column], Column], scores: str = "scores", out: str = "pred") -> DataFrame:
    """Reduce a score array to what the metric needs, before the scores travel."""
    return df.withColumn(out, fn(F.col(scores))).drop(scores)


def metric_fn(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A caller's metric over predictions and labels, written as an aggregation of few rows.

    What it returns must be small enough to report, so more than `MOST_RESULTS` rows are refused.
    """
    out = fn(df)
    if out.limit(MOST_RESULTS + 1).count() > MOST_RESULTS:
        raise ValueError(f"a metric returned more than {MOST_RESULTS} rows; it must aggregate")
    return out


def complete(
    prompts: DataFrame,
    predictor: Callable[[list[str], int], list[list[str]]],
    max_tokens: int = 128,
    n_samples: int = 1,
    key: str = "prompt_id",
    prompt: str = "prompt",
) -> DataFrame:
    """`(key, sample_id, completion, n_tokens, elapsed_s)` from a caller's predictor.

    The predictor takes a batch of prompts and returns each one's generated tokens. A
    batch's time is shared out evenly over its prompts.
    """
    kind = prompts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, sample_id int, completion string, n_tokens int, elapsed_s double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            generated = predictor(batch[prompt].tolist(), max_tokens)
            took = time.perf_counter() - start
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "sample_id": batch["sample_id"],
                    "completion": [" ".join(t) for t in generated],
                    "n_tokens": [len(t) for t in generated],
                    "elapsed_s": took / max(len(batch), 1),
                }
            )

    return expand_samples(prompts.select(key, prompt), n_samples).mapInPandas(run, schema)
