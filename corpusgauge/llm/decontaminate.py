"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case, punctuation apart. A document and a benchmark item that share a
seed of `LEAST` words in a row are tiled: the longest runs of words common to both, found by running
Karp-Rabin hashes, are marked, then the longest among the words not yet marked, down to `LEAST`
words. Order does not matter, so a passage whose sentences were moved around is covered just the
same. If the tiles cover at least `COVERAGE` of the item's words, the document leaks it.

The benchmark is taken in blocks of bounded size, each read by the driver and sent to the tasks;
documents stream through one pass per block, so neither side is shuffled and no pair is ever
emitted that shares no seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import bounded_batches, extended, frees, fresh, mix, utf8

LEAST = 5  # words of the shortest tile, and of a seed
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20  # benchmark text sent to the tasks at a time
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
APART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

LEAKS = "array<struct<item_id:bigint,n_covered:int,n_words:int,n_tiles:int>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("n_covered", pa.int32()), ("n_words", pa.int32()), ("n_tiles", pa.int32())]))


def compared(text: bytes) -> list[bytes]:
    return text.lower().translate(APART).split()


class Hashes:
    """Karp-Rabin hashes of all windows of a sequence, for any width, from running sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * _powers(INVERSE, n), out=self.sums[1:])
        self.up = _powers(BASE, n)

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def free_windows(marked: np.ndarray, width: int) -> np.ndarray:
    """Which windows of `width` hold no marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[width:] == sums[: len(sums) - width]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles `(item place, document place, words)`, longest first.

    Words of a document that the item lacks are 0. Search lengths fall from the item's own to
    `least`; a match longer than the search length is followed to its end before any is marked.
    """
    mine, theirs = Hashes(item), Hashes(doc)
    item_marked, doc_marked = np.zeros(len(item), bool), doc == 0
    found: list[tuple[int, int, int]] = []
    width = len(item)
    while width >= least:
        if len(doc) >= width:
            a = np.flatnonzero(free_windows(item_marked, width))
            b = np.flatnonzero(free_windows(doc_marked, width))
            ha, hb = mine.windows(width)[a], theirs.windows(width)[b]
            both = np.isin(hb, ha)
            places: dict[int, list[int]] = {}
            for i, h in zip(a.tolist(), ha.tolist()):
                places.setdefault(h, []).append(i)
            queue: list[tuple[int, int, int]] = []
            ends: dict[int, int] = {}  # diagonal -> end of the last match on it: its inner windows are part of it
            for j, h in zip(b[both].tolist(), hb[both].tolist()):
                for i in places[h]:
                    if ends.get(j - i, -1) >= j + width:
                        continue
                    n = 0
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not item_marked[i + n] and not doc_marked[j + n]:
                        n += 1
                    if n >= width:
                        queue.append((n, i, j))
                        ends[j - i] = j + n
            queue.sort(key=lambda m: (-m[0], m[1], m[2]))
            while queue:
                n, i, j = queue.pop(0)
                used = item_marked[i : i + n] | doc_marked[j : j + n]
                if used.any():
                    # What is left of an occluded match stays in line if it is long enough.
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], used.astype(np.int8), [1]])))
                    parts = [(int(e - s), i + int(s), j + int(s)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= width]
                    if parts:
                        queue = sorted(queue + parts, key=lambda m: (-m[0], m[1], m[2]))
                    continue
                item_marked[i : i + n] = doc_marked[j : j + n] = True
                found.append((i, j, n))
        width = width // 2 if width > 2 * least else least if width > least else 0
    return found


class Items:
    """A block of benchmark items, indexed by their words and seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.words, self.items = least, {}, []
        seeds, owners = [], []
        for item_id, text in rows:
            ws = compared((text or "").encode())
            if len(ws) < least:
                continue
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in ws], np.int64)
            own = np.unique(Hashes(ids).windows(least))
            seeds.append(own)
            owners.append(np.full(len(own), len(self.items)))
            self.items.append((item_id, ids))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def leaks(self, texts: list[bytes], coverage: float) -> list[list[dict]]:
        """Items leaked by each text."""
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.seeds):
            return out
        known = self.words.get
        split = [np.fromiter((known(w, 0) for w in compared(t)), np.int64) for t in texts]
        flat = np.concatenate([x for s in split for x in (s, [0])])
        n = len(flat) - self.least + 1
        if n <= 0:
            return out
        # Seeds without a foreign word, then those that some item has.
        spot = np.flatnonzero(free_windows(flat == 0, self.least))
        if not len(spot):
            return out
        hashes = window_hashes(flat, spot, self.least)
        hit = self.seeds[np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)] == hashes
        spot, hashes = spot[hit], hashes[hit]
        ends = np.cumsum([len(s) + 1 for s in split])
        owner = np.searchsorted(ends, spot, side="right")
        for k in np.unique(owner):
            mine = np.unique(hashes[owner == k])
            lo, hi = np.searchsorted(self.seeds, mine), np.searchsorted(self.seeds, mine, side="right")
            for q in np.unique(np.concatenate([self.owners[i:j] for i, j in zip(lo, hi)])):
                item_id, ids = self.items[q]
                near = neighbourhood(split[k], ids, spot[owner == k] - (ends[k] - len(split[k]) - 1), self.least)
                found = tiles(ids, near, self.least)
                covered = sum(t[2] for t in found)
                if covered >= coverage * len(ids):
                    out[k].append({"item_id": item_id, "n_covered": covered, "n_words": len(ids), "n_tiles": len(found)})
        return out


def window_hashes(ids: np.ndarray, spot: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that begin at the given places: what `Hashes.windows` gives there."""
    total = np.zeros(len(spot), np.uint64)
    inverse = _powers(INVERSE, width)
    for k in range(width):
        total += mix(ids[spot + k].astype(np.uint64)) * inverse[k]
    return total


def neighbourhood(doc: np.ndarray, item: np.ndarray, spot: np.ndarray, least: int) -> np.ndarray:
    """The document's words inside seeds, in order, other stretches shortened to one foreign word.

    Tiles lie wholly inside runs of seeds, so nothing else can be marked.
    """
    inside = np.zeros(len(doc) + 1, np.int64)
    np.add.at(inside, spot, 1)
    np.add.at(inside, spot + least, -1)
    keep = np.cumsum(inside[:-1]) > 0
    own = np.where(keep & np.isin(doc, item), doc, 0)
    return own[(own != 0) | np.concatenate([[True], own[:-1] != 0])]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's non-null rows in blocks of about so many bytes."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_bytes: int = BLOCK_BYTES, name: str = "leaks"
) -> DataFrame:
    """`docs` with `leaks`: per document, the benchmark items it covers, in order of their ids.

    Cases: a null or empty text leaks nothing; items without id or text, or of fewer than `least`
    words, are ignored; an item id that repeats is tested for each of its texts; rows that repeat
    are tested each; an empty table on either side is no error; other columns come along, one named
    `leaks` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.select(*[c for c in docs.columns if c.lower() != name])
    at = out.columns.index("text")
    kept = out.columns
    first = True
    for rows in item_blocks(benchmark.select("item_id", "text"), block_bytes):
        sent = spark.sparkContext.broadcast(rows)
        kind = extended(out, f"{name} {LEAKS}") if first else out.schema

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for b in batches:
                found = items.leaks(utf8(b.column(at)), coverage)
                if not first:
                    found = [sorted((old or []) + new, key=lambda x: x["item_id"]) for old, new in zip(b.column(len(kept)).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(found, LEAK_TYPE)], names=[*kept, name])

        out = out.mapInArrow(frees(run), kind)
        first = False
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no benchmark item, with their own columns."""
    (name,) = fresh(docs, "_leaks")
    return find_leaks(docs, benchmark, coverage, name=name).where(F.size(name) == 0).select(docs.columns)
