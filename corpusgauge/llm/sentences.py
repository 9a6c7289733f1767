"""Substring deduplication by sliding spans of several consecutive sentences.

A sentence ends with a full stop, exclamation or question mark, and quotes or brackets that close
behind it, that a blank follows, with a full stop of another script, or with its line. From every
sentence on a span runs over as many as hold two sentences and `WORDS` words: a passage set into
other text loses only its first and last sentence, and two short sentences alone are no passage.
Every span is hashed, repeated ones are found over the whole corpus, and of each but the first
occurrence the covered sentences are removed. See `repeats` for order, scale and the cases of nulls,
blanks, short documents and repeated rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from corpusgauge.llm.repeats import cut_repeats

WIDTH, WORDS = 2, 16  # a span's least number of sentences and of words
BLANKS = " \t\r\n\v\f"
END = re.compile(r"""[.!?]["'”’»)\]]*[ \t\r\n]|[。！？।؟]|\n""")


def sentence_units(text: str) -> tuple[list[str], list[str]]:
    """Sentences with the blank that ends them, compared without blanks around them."""
    ends = [0, *[m.end() for m in END.finditer(text)], len(text)]
    pieces = [text[i:j] for i, j in zip(ends, ends[1:])]
    return pieces, [p.strip(BLANKS) for p in pieces]


def dedup_sentences(docs: DataFrame, width: int = WIDTH, least: int = WORDS) -> DataFrame:
    """`docs` without the sentences covered by a repeated span; adds `n_units` and `n_removed`."""
    return cut_repeats(docs, sentence_units, width, least=least)
