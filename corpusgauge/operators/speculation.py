"""Draft verification and acceptance accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import accept_rate


def verify_draft(df: DataFrame, by: Sequence[str] = ("sample", "step")) -> DataFrame:
    """`(by.., proposed, matched)`: the accepted prefix ends at the first disagreement."""
    wrong = ~F.col("draft").eqNullSafe(F.col("target"))
    return df.groupBy(*by).agg(
        F.count("*").alias("proposed"),
        F.coalesce(F.min(F.when(wrong, F.col("pos"))), F.count("*")).alias("matched"),
    )


def acceptance_steps(df: DataFrame, proposed: str = "proposed", matched: str = "matched") -> DataFrame:
    """Accepted and rejected tokens of a verify step, and whether it rolled back, 1 or 0."""
    bad = F.col(proposed) - F.col(matched)
    return (
        df.withColumn("accepted", F.col(matched))
        .withColumn("rejected", bad)
        .withColumn("rollbacks", (bad > 0).cast("int"))
    )


def acceptance(df: DataFrame, by: Sequence[str] = ("run_id",), guard: str = "max1") -> DataFrame:
    """Steps totalled per run, with the acceptance rate."""
    steps = acceptance_steps(df)
    totals = steps.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"),
        F.sum("rollbacks").alias("rollbacks"),
    )
    return totals.withColumn("accept_rate", accept_rate("accepted", "rejected", guard))


def mean_acceptance(
    df: DataFrame,
    by: Sequence[str] = (),
    rate: Column | str = "accept_ratio",
    rollbacks: Column | str = "rollbacks",
    ignore_missing: bool = False,
) -> DataFrame:
    """Mean acceptance and roll-backs per sequence, in one aggregate.

    A sequence without details counts as NaN acceptance and no roll-backs, so it turns
    `mean_accept` to NaN unless missing ones are ignored; `mean_known` leaves them out always.
    """
    r = F.col(rate) if isinstance(rate, str) else rate
    b = F.col(rollbacks) if isinstance(rollbacks, str) else rollbacks
    aggregates = [
        F.count("*").alias("sequences"),
        F.avg(r if ignore_missing else F.coalesce(r, F.lit(float("nan")))).alias("mean_accept"),
        F.avg(r).alias("mean_known"),
        F.avg(F.coalesce(b, F.lit(0))).alias("mean_rollbacks"),
    ]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
