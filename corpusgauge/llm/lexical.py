"""Ranked lexical search: documents scanned for all items' terms by an Aho-Corasick automaton.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered.
The automaton holds each distinct term of the items between two blanks, and texts are scanned with
everything that is no term character made a blank, so a match is a whole term. One scan counts how
many documents hold each term, a second one weighs term frequencies into scores; no index of the
documents is built or stored in between. An output of the automaton is a term's number, and arrays
map it to the items that hold it. A task keeps the best documents of each item, so what is shuffled
grows with tasks and items, not with documents.

Items are taken in blocks of at most `BLOCK_BYTES` of text (or one item, if that is longer): only a
block's automaton is sent to the tasks at a time, and the documents are scanned twice per block.

Cases: a null text, of a document or an item, holds no term, and such an item returns no row; every
row of either table counts for itself, also if it repeats an id or a whole row; equal scores rank by
ascending document id, a null id last; very long texts are scanned whole; an empty table on either
side gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import batch, bounded_batches, frees, utf8
from corpusgauge.operators.ordering import running_offset
from corpusgauge.session import materialise

BEST = 10
BLOCK_BYTES = 1 << 20
# What holds text apart becomes a blank, A-Z become small; bytes beyond ASCII stay.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
DOCUMENTS, LENGTHS = -1, -2  # rows of the counts that are no terms

COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def plain(text: bytes) -> bytes:
    return text.translate(PLAIN)


def split(text: str | None) -> list[str]:
    return [w.decode() for w in plain((text or "").encode()).split()]


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each term between blanks; its output is the term's place in the list."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        found.add_word(f" {term} ", k)
    found.make_automaton()
    return found


def scan(text: bytes, terms: ahocorasick.Automaton) -> tuple[int, Counter]:
    """How many terms a text has, and how often each one the automaton knows."""
    text = plain(text)
    n = len(text.split())
    return n, Counter(map(itemgetter(1), terms.iter(f" {text.decode()} "))) if n and len(terms) else Counter()


def count_terms(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and how many documents hold each of `terms`."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, holding = automaton(sent.value), np.zeros(len(sent.value), np.int64)
        n_docs = n_terms = 0
        for b in batches:
            for text in utf8(b.column(0)):
                n, found = scan(text, known)
                n_docs += n > 0
                n_terms += n
                holding[list(found)] += 1
        met = np.flatnonzero(holding)
        yield batch(COUNTS, [*met.tolist(), DOCUMENTS, LENGTHS], [*holding[met].tolist(), n_docs, n_terms])

    rows = docs.select("text").mapInArrow(frees(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    sent.unpersist()
    counts = dict(map(tuple, rows))  # one a term of the block
    df = np.array([counts.get(k, 0) for k in range(len(terms))], np.int64)
    return counts.get(DOCUMENTS, 0), counts.get(LENGTHS, 0), df


class Postings:
    """Which items hold a term and how often, as flat arrays, and the terms' weights."""

    def __init__(self, items: list[list[str]]):
        self.terms = sorted(set().union(*items))
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((number[t], k, n) for k, own in enumerate(items) for t, n in Counter(own).items())
        term, self.item, self.repeats = np.array(pairs, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_items = len(items)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def score(self, found: Counter, m: int) -> np.ndarray:
        """Each item's score for a document with these terms."""
        out = np.zeros(self.n_items, np.int64)
        term = np.fromiter(found.keys(), np.int64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        worth = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        n = self.first[term + 1] - self.first[term]
        ends = np.cumsum(n)
        spot = np.repeat(self.first[term] - (ends - n), n) + np.arange(ends[-1])
        np.add.at(out, self.item[spot], np.repeat(worth, n) * self.repeats[spot])
        return out


class Leaders:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.heaps: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a lower score can't enter

    def add(self, doc_id: int | None, score: np.ndarray) -> None:
        for k in np.flatnonzero(score >= self.least).tolist():
            heap, entry = self.heaps[k], (int(score[k]), doc_id is not None, -(doc_id or 0))
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.least[k] = heap[0][0]

    def rows(self) -> list[tuple]:
        return [(k, -i if known else None, s) for k, heap in enumerate(self.heaps) for s, known, i in heap]


def search_block(docs: DataFrame, texts: list[str | None], best: int) -> DataFrame:
    """`(item, doc_id, score)`: each task's best documents of the items, which go by their place in the list."""
    spark, postings = docs.sparkSession, Postings([split(x) for x in texts])
    n_docs, n_terms, df = count_terms(docs, postings.terms)
    postings.weigh(n_docs, df)
    sent = spark.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known, leaders = automaton(own.terms), Leaders(own.n_items, best)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                n, found = scan(text, known)
                if found:
                    leaders.add(doc_id, own.score(found, 25 + 75 * n * n_docs // n_terms))
        if rows := leaders.rows():
            yield batch(FOUND, *zip(*rows, strict=True))

    found = docs.select("doc_id", "text").mapInArrow(frees(run), "item bigint, doc_id bigint, score bigint")
    stored = materialise(found)
    sent.unpersist()
    return stored


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the `best` documents of each item, of those that score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = materialise(items.select("item_id", "text", F.monotonically_increasing_id().alias("row")))
    own = running_offset(own, "row", F.coalesce(F.octet_length("text"), F.lit(0)), "at")
    own = materialise(own.withColumn("block", F.floor(F.col("at") / block_bytes)))
    out = spark.createDataFrame([], f"row bigint, {_kind(items)}, doc_id bigint, score bigint")
    for (k,) in own.select("block").distinct().orderBy("block").toLocalIterator():
        block = own.where(F.col("block") == k).orderBy("row").collect()  # of bounded bytes
        found = search_block(docs, [r["text"] for r in block], best)
        names = spark.createDataFrame([(i, r["row"], r["item_id"]) for i, r in enumerate(block)], f"item bigint, row bigint, {_kind(items)}")
        out = out.union(found.join(F.broadcast(names), "item").select("row", "item_id", "doc_id", "score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _kind(items: DataFrame) -> str:
    return f"item_id {items.schema['item_id'].dataType.simpleString()}"
