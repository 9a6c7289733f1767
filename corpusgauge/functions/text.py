"""Text scalars with Python's notion of blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.split() and str.strip() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Drop blanks of every kind at both ends (plain trim drops spaces only)."""
    return F.btrim(as_column(col), F.lit(BLANKS))


def newline_to_space(col: Column | str) -> Column:
    return F.translate(as_column(col), "\n", " ")


def words(col: Column | str) -> Column:
    """Blank-separated words; runs collapse and no empty word appears.

    Mapping every blank to a space first lets the split use a plain delimiter, which is
    faster than splitting or matching by a regular expression.
    """
    spaced = F.translate(as_column(col), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def first_words(col: Column | str, n: int = 128) -> Column:
    return F.array_join(F.slice(words(col), 1, n), " ")


def last_word(col: Column | str) -> Column:
    return F.element_at(words(col), -1)


def all_but_last_word(col: Column | str) -> Column:
    w = words(col)
    return F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), " ")


def strip_prompt(generated: Column | str, prompt: Column | str) -> Column:
    """What follows the prompt's characters in a generated text."""
    return F.substr(as_column(generated), F.length(as_column(prompt)) + 1)


def preview(col: Column | str, n: int = 200) -> Column:
    return F.concat(F.left(as_column(col), F.lit(n)), F.lit("..."))


def ensure_prefix(col: Column | str, bos: str) -> Column:
    c = as_column(col)
    return F.when(F.startswith(c, F.lit(bos)), c).otherwise(F.concat(F.lit(bos), c))


def run_name(model_id: Column | str, *parts: Column | str) -> Column:
    """Last path segment with dots made dashes, then the parts, joined by dashes."""
    base = F.replace(F.element_at(F.split(as_column(model_id), "/"), -1), F.lit("."), F.lit("-"))
    return F.concat_ws("-", base, *[as_column(p) for p in parts])
