"""Line deduplication by overlapping windows of three consecutive lines.

Every run of three non-blank lines is hashed, windows repeated in the corpus are found, and of each
but the first occurrence the covered lines are removed; overlapping windows are merged. See
`repeats` for order, scale and the cases of nulls, blanks, short documents and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusgauge.llm.repeats import cut_repeats

WIDTH = 3
BLANKS = " \t\r\v\f"


def line_units(text: str) -> tuple[list[str], list[str]]:
    """Lines with their line feeds, compared without blanks around them."""
    lines = text.split("\n")
    pieces = [line + "\n" for line in lines[:-1]] + lines[-1:]
    return pieces, [line.strip(BLANKS) for line in lines]


def dedup_lines(docs: DataFrame, width: int = WIDTH, counts: tuple[str, str] = ("n_units", "n_removed")) -> DataFrame:
    """`docs` without the lines covered by a repeated window; adds the counts of lines compared and removed."""
    return cut_repeats(docs, line_units, width, counts)
