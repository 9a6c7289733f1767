"""Numeric scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import as_column


def to_gb(col: Column | str) -> Column:
    return as_column(col) / F.lit(1e9)


def to_ms(col: Column | str) -> Column:
    return as_column(col) * F.lit(1000.0)


def round2(col: Column | str) -> Column:
    """Round to two places, halves to even on the scaled value, as numpy does."""
    return F.rint(as_column(col) * 100.0) / 100.0


def ppl_from_loss(col: Column | str) -> Column:
    """exp(loss); a loss too big for a double gives Infinity."""
    return F.exp(as_column(col).cast("double"))


def accept_rate(accepted: Column | str, rejected: Column | str, guard: str = "max1") -> Column:
    """Share of proposed tokens that were accepted, guarded against no proposals."""
    a, r = as_column(accepted), as_column(rejected)
    if guard == "max1":
        return a.cast("double") / F.greatest(a + r, F.lit(1))
    if guard == "eps":
        return a / (a + r + F.lit(1e-9))
    raise ValueError(f"guard must be 'max1' or 'eps', not {guard!r}")


def per_token(seconds: Column | str, tokens: Column | str) -> Column:
    return F.try_divide(as_column(seconds), as_column(tokens))


def per_second(tokens: Column | str, seconds: Column | str) -> Column:
    return F.try_divide(as_column(tokens), as_column(seconds))


def nan_to_null(col: Column | str) -> Column:
    c = as_column(col).cast("double")
    return F.when(~F.isnan(c), c)
