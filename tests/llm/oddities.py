"""A small documents table with every odd case, and brute-force helpers."""

from __future__ import annotations

import os
import random
import re

import pytest

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, score double, leaks string, fp string, _later int, row string, word string"

SYLLABLES = {"en": "the of and ing tion ent her for tha nth wha ter".split(), "de": "der die und sch ein ich ung keit zu ver ß ü".split(), "fr": "les des ent que é à tion eau oi ment re è".split()}


def sentence(rng: random.Random, lang: str = "en", n: int = 9) -> str:
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def paragraph(rng: random.Random, lang: str = "en", lines: int = 6) -> str:
    return "\n".join(" ".join(sentence(rng, lang, rng.randint(4, 12)) for _ in range(rng.randint(1, 4))) for _ in range(lines))


def documents(seed: int = 7) -> list[tuple]:
    """Rows of `SCHEMA`: copies, near copies, shared passages, nulls, blanks, ties and clashing columns."""
    rng = random.Random(seed)
    rows: list[tuple] = []

    def add(text, lang="en", doc_id="next"):
        number = len(rows) * 3 if doc_id == "next" else doc_id
        rows.append((number, text, lang, f"src{len(rows) % 3}", None if text is None else len(text), 1, 0.5, "x", "y", 3, "z", "w"))

    shared = paragraph(rng, lines=5)
    for k in range(40):
        lang = ("en", "en", "de", "fr")[k % 4]
        own = paragraph(rng, lang, rng.randint(1, 9))
        add(own + "\n" + shared + "\n" + sentence(rng) if k % 7 == 0 else own, lang)
    for k in (0, 0, 5, 5, 9):
        add(rows[k][1])  # exact copies
    words = rows[3][1].split(" ")
    words[len(words) // 2] = "changed"
    add(" ".join(words), "fr")
    add(rows[2][1] + " Tail.", None)
    for text in (None, "", " ", "\n\n \t\n", "a", "é", "12 34 !!", "x" * 5000, "ab " * 900, "Same line\n" * 40, "The. The. The. The. The.\n" * 3, "퟿     \u0085 x"):
        add(text, None if text is None else "en")
    add(rows[1][1], doc_id=rows[1][0])  # a row twice
    add("another text of the same id. " * 3, doc_id=rows[4][0])
    add(rows[6][1], doc_id=None)
    add(None, None, doc_id=None)
    add(" ".join(paragraph(rng, lines=30) for _ in range(12)))  # long
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split_words(text: str | None) -> list[str]:
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(scope="session")
def sf():
    """A folder of test tables; a module that asks for it imports this."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
