"""Repeated runs of units (lines or sentences) across documents: hash, join globally, cut.

A document's units are its consecutive pieces; joined again they are the text. Units with
something to compare are numbered, and every run of `width` of them is a window; if a window must hold
a least number of words, it runs on until it does. A window counts as
repeated if an equal one stands in a document with a smaller id, or earlier in the same document;
units that any such window covers are removed. Windows are compared by 128 bits of hash.

Occurrences later in a document are settled where they are found, so per document a window is
shuffled once. The smallest id per window is a combined minimum, and only windows seen in more than
one document are joined back, on the window; adaptive execution splits one that very many share.
No window's occurrences are ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import bounded_batches, extended, frees, fresh
from corpusgauge.session import materialise

Units = Callable[[str], tuple[list[str], list[str]]]  # text -> pieces, and what of each is compared ("": nothing)

LAST = (1 << 63) - 1  # stands for a null id, which comes after all others


def window_ends(words: list[int], width: int, least: int) -> list[int]:
    """Where the shortest run from each unit on ends that holds `width` units and `least` words."""
    ends, end, held = [], 0, 0
    for start, own in enumerate(words):
        while end < len(words) and (end - start < width or held < least):
            held += words[end]
            end += 1
        if end - start < width or held < least:
            break
        ends.append(end)
        held -= own
    return ends


def window_hashes(compared: list[str], width: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the units that count, and each window's 128-bit hash (n, 2) and end; the kth begins at the kth unit."""
    at = [k for k, c in enumerate(compared) if c]
    texts = [compared[k].encode() for k in at]
    ends = window_ends([len(t.split()) for t in texts], width, least) if least else list(range(width, len(at) + 1))
    if not ends:
        return np.array(at, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    own = [xxhash.xxh128_digest(t) for t in texts]
    found = b"".join([xxhash.xxh128_digest(b"".join(own[k:end])) for k, end in enumerate(ends)])
    return np.array(at, np.int64), np.frombuffer(found, "<i8").reshape(-1, 2), np.array(ends, np.int64)


def first_here(hashes: np.ndarray) -> np.ndarray:
    """Which windows are the first of their kind in the document."""
    first = np.zeros(len(hashes), bool)
    if len(hashes):
        _, spot = np.unique(hashes, axis=0, return_index=True)
        first[spot] = True
    return first


def windows(docs: DataFrame, units: Units, width: int, least: int = 0) -> DataFrame:
    """`(doc, version, h1, h2, at)`: each document's distinct windows and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for body in b.column(2).to_pylist():
                _, hashes, _ = window_hashes(units(body or "")[1], width, least)
                spot = np.flatnonzero(first_here(hashes))
                rows.append((hashes[spot, 0], hashes[spot, 1], spot.astype(np.int32)))
            keep = [k for k, r in enumerate(rows) if len(r[2])]
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)],
                    *[pa.array([rows[k][c] for k in keep], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))],
                ],
                names=["doc", "version", "h1", "h2", "at"],
            )

    listed = docs.mapInArrow(frees(run), "doc bigint, version int, h1 array<bigint>, h2 array<bigint>, at array<int>")
    return listed.select("doc", "version", F.inline(F.arrays_zip("h1", "h2", "at")))


def later_windows(docs: DataFrame, units: Units, width: int, least: int = 0) -> DataFrame:
    """`(doc, version, at)`: windows that an earlier document also has."""
    found = materialise(windows(docs, units, width, least))
    first = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # Stored, so that the join is not tied to the grouping's partitions and a hot window can be split.
    shared = materialise(first.where(F.col("last") > F.col("first")).select("h1", "h2", "first"))
    return found.join(shared, ["h1", "h2"]).where(F.col("doc") > F.col("first")).select("doc", "version", "at")


def cut_repeats(
    docs: DataFrame, units: Units, width: int, counts: tuple[str, str] = ("n_units", "n_removed"), least: int = 0
) -> DataFrame:
    """`docs` with the repeated units taken out of `text`, and two counts added.

    `n_units` counts the units compared, `n_removed` those taken out. A text that loses nothing is returned as it was.

    Cases: a null text stays null, with no units; units that are blank take no part and stay; a
    document of fewer than `width` units, or of fewer than `least` words, has no window and stays whole; rows that share an id are
    versions of one document: none comes before another, and what an earlier document makes one of
    them lose is lost by each where it has the same window; a null id comes after all others; an
    empty table gives an empty result; other columns come along, those named like the new ones are
    replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in counts]
    docs = docs.select(kept)
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    version = F.hash("text")
    narrow = docs.select(doc.alias("doc"), version.alias("version"), "text")
    # A document's flags are bounded by its own units.
    later = later_windows(narrow, units, width, least).groupBy("doc", "version").agg(F.collect_set("at").alias("at"))
    own_doc, own_version, own_later = fresh(docs, "_doc", "_version", "_later")
    flags = later.select(F.col("doc").alias(own_doc), F.col("version").alias(own_version), F.col("at").alias(own_later))
    joined = docs.withColumns({own_doc: doc, own_version: version}).join(flags, [own_doc, own_version], "left")
    at = kept.index("text")
    kind = extended(docs, f"{counts[0]} bigint, {counts[1]} bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, compared, gone = [], [], []
            for body, flags in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                text, n, lost = cut(body, flags or [], units, width, least)
                texts.append(text)
                compared.append(n)
                gone.append(lost)
            columns = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(compared, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, *counts]
            )

    return joined.select(*kept, own_later).mapInArrow(frees(run), kind)


def cut(body: str | None, later: list[int], units: Units, width: int, least: int = 0) -> tuple[str | None, int, int]:
    """A text without its repeated units, the units compared, and how many went."""
    pieces, compared = units(body or "")
    at, hashes, ends = window_hashes(compared, width, least)
    starts = np.union1d(np.flatnonzero(~first_here(hashes)), np.array(later, np.int64)).astype(np.int64)
    if not len(starts):
        return body, len(at), 0
    # Merge what the windows cover: +1 where one begins, -1 behind its last unit.
    step = np.zeros(len(at) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends[starts], -1)
    covered = np.cumsum(step[:-1]) > 0
    lost = set(at[covered].tolist())
    return "".join(p for k, p in enumerate(pieces) if k not in lost), len(at), len(lost)
