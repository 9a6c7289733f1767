"""System-metric histories of runs and profiler-style summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import nan_to_null, round2
from corpusgauge.operators.joins import null_safe_join
from corpusgauge.operators.ordering import share_of_total
from corpusgauge.operators.quantiles import exact_percentiles


def mean_by_run(history: DataFrame, metric: str) -> DataFrame:
    """`(run_id, n_rows, mean)` for every run in the history; null mean if the metric is absent."""
    value = F.when(F.col("metric") == metric, nan_to_null("value"))
    return history.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"))


def attach_history(runs: DataFrame, means: DataFrame) -> DataFrame:
    """Every requested run with its mean, `N/A`, or an error row when the run is unknown.

    What else `runs` says of a run, such as its `run_name`, comes along.
    """
    joined = runs.join(means, "run_id", "left")
    unknown = F.col("n_rows").isNull()
    return joined.select(
        *runs.columns,
        round2("mean").alias("mean"),
        F.when(unknown, F.concat(F.lit("Error: no run "), F.col("run_id").cast("string")))
        .when(F.col("mean").isNull(), F.lit("N/A"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


def mean_by_export(lines: DataFrame, metric: str) -> DataFrame:
    """`(run_id, n_rows, mean, n_unread)` from `records.read_exports`."""
    value = F.when(F.col("metric") == metric, nan_to_null("value"))
    return lines.groupBy("run_id").agg(
        F.count_if(F.col("metric").isNotNull()).alias("n_rows"), F.avg(value).alias("mean"), F.count("unread").alias("n_unread")
    )


def attach_exports(runs: DataFrame, means: DataFrame) -> DataFrame:
    """`attach_history` for exports: a run whose file is damaged is an error row too, and ends nothing.

    Of a damaged file no mean is given, since the lines that are gone would have changed it.
    """
    sound = means.withColumn("mean", F.when(F.col("n_unread") == 0, F.col("mean")))
    told = attach_history(runs, sound).join(means.select("run_id", "n_unread"), "run_id", "left")
    damaged = F.concat(F.lit("Error: "), F.col("n_unread").cast("string"), F.lit(" unreadable lines"))
    return told.withColumn("status", F.when(F.col("n_unread") > 0, damaged).otherwise(F.col("status"))).select(*runs.columns, "mean", "status")


def named_summary(df: DataFrame, name: str, value: str, report: str | None = None) -> DataFrame:
    """Share, total, count, mean, median, extremes and deviation per name, biggest total first.

    Shares are within a report. One row has no deviation, shown as 0. A null name or report
    is a group like any other; a name without values has null statistics.
    """
    keys: Sequence[str] = [report, name] if report else [name]
    totals = df.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.count(value).alias("n"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
    )
    medians = exact_percentiles(df, keys, value, {"med": 0.5})
    shared = share_of_total(totals, "total", [report] if report else None)
    return null_safe_join(shared, medians, list(keys), "left").orderBy(
        *([F.asc(report)] if report else []), F.desc("total"), F.asc(name)
    )
