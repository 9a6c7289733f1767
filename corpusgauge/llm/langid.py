"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter per language, stored slice by slice: slot s holds a mask with bit l set if language l's
filter has slot s set. And-ing the masks of an n-gram's slots gives every language that contains
it at once. A document's count for a language is the popcount of that bit over its n-grams. A
filter whose slots are filled to a share f lets a foreign n-gram through with probability f^k, and
the counts are corrected for this before the largest decides.

An n-gram enters a language's filter if it makes up at least `MIN_RATE` of that language's n-grams
and at least `MIN_SHARE` of its rate in the language where it is most common. So a language puts at
most 1 / MIN_RATE n-grams in, whatever the corpus, and the filters have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import bounded_batches, extended, frees, mix

GRAM = 4  # characters of an n-gram, blanks between words included
SLOTS = 1 << 20
PROBES = 2
MIN_RATE = 1e-5
MIN_SHARE = 0.2
SAMPLE_ROWS = 20_000  # labelled documents per language, at most about so many, to fit the filters on
SLICE = 1 << 20  # characters scored at a time
UNDETERMINED = "und"

_BLANK = 32


def letter_table() -> np.ndarray:
    """Code point to lower-case letter, or blank for all that is no letter."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = letter_table()
    return _letters


def code_points(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def grams(points: np.ndarray) -> np.ndarray:
    """64-bit n-grams of lower-case letters and single blanks; a row of blanks counts as one.

    `points` starts and ends with a blank. Grams with a blank inside (not at an end) are left out.
    """
    blank = points == _BLANK
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(points) < GRAM:
        return np.zeros(0, np.uint64)
    n = len(points) - GRAM + 1
    out = np.zeros(n, np.uint64)
    inside = np.zeros(n, bool)
    for k in range(GRAM):
        own = points[k : k + n]
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ own.astype(np.uint64)
        if 0 < k < GRAM - 1:
            inside |= own == _BLANK
    return out[~inside]


def text_grams(text: str) -> Iterator[np.ndarray]:
    """A text's n-grams, a bounded slice at a time; slices overlap so that none is lost or doubled."""
    edge = np.array([_BLANK], np.uint32)
    held = edge
    for at in range(0, len(text), SLICE):
        points = np.concatenate([held, code_points(text[at : at + SLICE])])
        if at + SLICE >= len(text):
            yield grams(np.concatenate([points, edge]))
            return
        # Cut at a blank: the part after it starts the next slice.
        ends = np.flatnonzero(points == _BLANK)
        cut = int(ends[-1])
        if cut == 0:
            cut = len(points) - GRAM  # one endless word
            yield grams(points[: cut + GRAM - 1])
            held = points[cut:]
            continue
        yield grams(points[: cut + 1])
        held = points[cut:]


@dataclass
class Filters:
    """Bit-sliced filters: `masks[w, slot]` holds 64 languages; `fill` is each language's filled share."""

    langs: list[str]
    masks: np.ndarray
    fill: np.ndarray

    def slots(self, found: np.ndarray, probe: int) -> np.ndarray:
        return (mix(found + np.uint64(probe * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(self.masks.shape[1])).astype(np.int64)

    def add(self, found: np.ndarray, lang: int) -> None:
        bit = np.uint64(1 << (lang % 64))
        for k in range(PROBES):
            self.masks[lang // 64, self.slots(found, k)] |= bit
        self.fill[lang] = np.mean((self.masks[lang // 64] & bit) != 0)

    def containing(self, found: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram, one row per 64 languages."""
        hit = self.masks[:, self.slots(found, 0)]
        for k in range(1, PROBES):
            hit &= self.masks[:, self.slots(found, k)]
        return hit

    def corrected(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """True counts expected behind the popcounts, given each filter's false positive rate."""
        false = self.fill**PROBES
        return np.clip((counts - n[:, None] * false) / np.maximum(1 - false, 1e-9), 0, None)


def empty_filters(langs: list[str], slots: int = SLOTS) -> Filters:
    return Filters(langs, np.zeros((max(1, -(-len(langs) // 64)), slots), np.uint64), np.zeros(len(langs)))


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`(lang, gram, n)` over all given documents; counts are combined in each task first."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                own, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own)), pa.array(own.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )
            held.clear()

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for found in text_grams(body or ""):
                    held.setdefault(name, []).append(found)
                    size += len(found)
                    if size > 4_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = docs.select(F.col(lang), F.col(text)).mapInArrow(frees(count), "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slots: int = SLOTS) -> Filters:
    """Filters of every language in `lang`, from a bounded sample of `docs` (`doc_id, text, lang`).

    Per language, about `sample_rows` documents are used: those whose hashed id falls below the
    share that this is of the language's documents. Nulls in `lang` or `text` teach nothing.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    out = empty_filters(langs, slots)
    if not langs:
        return out
    buckets = 1 << 20
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))
    keep: Column | None = None
    for name in langs:
        cut = max(1, min(buckets, int(buckets * sample_rows / sizes[name])))
        one = (F.col("lang") == name) & (spot < cut)
        keep = one if keep is None else keep | one
    counts = gram_counts(docs.where(keep))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # At most 1 / MIN_RATE n-grams of a language reach the driver.
    share = F.lit(0.0)
    for name, n in totals.items():
        share = F.when(F.col("lang") == name, F.col("n") / float(n)).otherwise(share)
    common = counts.select("lang", "gram", share.alias("rate")).where(F.col("rate") >= MIN_RATE)
    most = common.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = common.join(most, "gram").where(F.col("rate") >= MIN_SHARE * F.col("most"))
    rows = kept.select("lang", "gram").toPandas()
    for k, name in enumerate(langs):
        out.add(rows.loc[rows["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64), k)
    return out


def count_languages(texts: list[str | None], filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Popcounts per text and language, n-grams per text, and whether it has a letter."""
    counts = np.zeros((len(texts), len(filters.langs)))
    n = np.zeros(len(texts))
    lettered = np.zeros(len(texts), bool)
    held, owner, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            found, lengths = np.concatenate(held), np.array([len(h) for h in held])
            if len(found):
                hit = filters.containing(found)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                some = lengths > 0
                for k in range(len(filters.langs)):
                    bits = ((hit[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int32)
                    np.add.at(counts[:, k], np.array(owner)[some], np.add.reduceat(bits, starts[some]))
            held.clear()
            owner.clear()
            size = 0

    for at, body in enumerate(texts):
        if not body:
            continue
        lettered[at] = any(map(str.isalpha, body))
        for found in text_grams(body):
            held.append(found)
            owner.append(at)
            n[at] += len(found)
            size += len(found)
            if size > SLICE:
                flush()
    flush()
    return counts, n, lettered


def predict(docs: DataFrame, filters: Filters, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to `docs`, from its `text` alone.

    The score is the winner's corrected count over the document's n-grams, at most 1. Ties go to
    the language that sorts first.

    Cases: `und` with score 0 for a null text, one without a letter, or if no language was learned;
    a text with letters but no known n-gram gets the first language with score 0; rows that repeat
    are predicted each; an empty table gives an empty result; other columns come along, those
    named like the new ones are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((filters.langs, filters.masks, filters.fill))
    kept = [c for c in docs.columns if c.lower() not in (pred, score)]
    at = kept.index("text")
    kind = extended(docs.select(kept), f"{pred} string, {score} double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*sent.value)
        for b in batches:
            counts, n, lettered = count_languages(b.column(at).to_pylist(), own)
            names, scores = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            if own.langs:
                best = own.corrected(counts, n)
                top = best.argmax(axis=1)
                scores = np.where(lettered, np.clip(best[np.arange(len(top)), top] / np.maximum(n, 1), 0, 1), 0.0)
                names = [own.langs[k] if ok else UNDETERMINED for k, ok in zip(top.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*kept, pred, score]
            )

    return docs.select(kept).mapInArrow(frees(run), kind)
