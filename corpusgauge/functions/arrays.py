"""Token-array scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import as_column

IGNORED = -100  # fixed value: label that takes no part in the loss


def token_count(ids: Column | str) -> Column:
    return F.size(as_column(ids))


def first_tokens(ids: Column | str, n: int = 128) -> Column:
    return F.slice(as_column(ids), 1, n)


def pad_ids(ids: Column | str, length: Column | int, pad_id: int) -> Column:
    """Pad on the right; arrays already long enough are left alone."""
    c = as_column(ids)
    missing = F.greatest(F.lit(length) - F.size(c), F.lit(0))
    return F.concat(c, F.array_repeat(F.lit(pad_id), missing))


def attention_mask(ids: Column | str, length: Column | int) -> Column:
    c = as_column(ids)
    missing = F.greatest(F.lit(length) - F.size(c), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), missing))


def mask_prefix(ids: Column | str, n: Column | int) -> Column:
    """Replace the first n ids by the ignored label."""
    c = as_column(ids)
    n = n if isinstance(n, Column) else F.lit(n)
    masked = F.least(F.greatest(n, F.lit(0)), F.size(c))
    return F.concat(F.array_repeat(F.lit(IGNORED), masked), F.slice(c, masked + 1, F.size(c)))


def mask_all_but_last(ids: Column | str, n: Column | int) -> Column:
    """Keep the last n ids as labels; nothing is masked once n reaches the length."""
    c = as_column(ids)
    n = n if isinstance(n, Column) else F.lit(n)
    return mask_prefix(c, F.when(n > 0, F.size(c) - n).otherwise(0))


def unmasked(labels: Column | str) -> Column:
    return F.size(F.array_remove(as_column(labels), F.lit(IGNORED)))


def argmax(scores: Column | str) -> Column:
    """0-based position of the first greatest score."""
    c = as_column(scores)
    return F.array_position(c, F.array_max(c)) - 1


def previous(tokens: Column | str, start: Column, back: int = 1) -> Column:
    """Array aligned with `tokens`: the token `back` places earlier, `start` before the first."""
    c = as_column(tokens)
    return F.slice(F.concat(F.array_repeat(start, back), c), F.lit(1), F.size(c))
