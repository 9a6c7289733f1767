"""Report tables behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import as_column


def plain_hyphens(col: Column | str) -> Column:
    """Non-breaking hyphens U+2011 made plain, so labels of two tables meet."""
    return F.translate(as_column(col), "‑", "-")


def series(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Rows ordered as plotted: one line per combination of `by`, points along `x`."""
    return df.orderBy(*by, x)


def pivot_metric(df: DataFrame, row: str, col: str, value: str, levels: Sequence[str]) -> DataFrame:
    """One row per `row`, one column per given level; listing levels spares a scan."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.first(value, ignorenulls=True))


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """`(ids.., metric, value)`, one row per chosen metric column."""
    columns = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*ids, *columns).unpivot(list(ids), list(metrics), "metric", "value")
