"""Exact substring deduplication on merged Burrows-Wheeler transforms.

A byte goes if it lies in a `WINDOW`-byte string that starts anywhere else in the corpus too. What
repeats is read off the common prefixes of merged transforms (see `bwt`), but only suffixes that can
repeat are ever sorted, and equal strings meet in one task without any task holding the corpus:

1. Anchors. In every window, the leftmost least of its hashed `ANCHOR`-byte strings is the window's
   anchor. Windows in a row that have one anchor make a segment, about one per 85 bytes. Equal
   windows have equal anchors at equal places, so a repeat can only be between segments of one
   anchor content. Segments are counted by the anchor's hash; those alone with theirs drop out.
2. Copies. Segments equal throughout are folded to one with a weight. If all of an anchor's segments
   are equal, each of their windows repeats.
3. Transforms. The other distinct segments are dealt to tasks by anchor. A segment is read as 8-byte
   symbols in line with its anchor; a task sorts shards of segments, merges their transforms and
   reads intervals of suffixes that share the 24 or 25 symbols inside a window. The window's bytes
   outside whole symbols are compared last.
4. Repeated windows go back to their documents, where the bytes they cover are removed.

An anchor of more than `GROUP` distinct segments would be too much for one task. Its windows are
hashed and counted one by one instead, combined before the shuffle, which takes more rows but no
group at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm import bwt
from corpusgauge.llm.common import batch, bounded_batches, frees, mix, utf8
from corpusgauge.session import materialise

WINDOW = 200
ANCHOR = 32
STEP = 8  # bytes of a symbol
BLOCK = 1 << 20  # bytes of a text that are hashed at a time
PLACE_BITS = 24
CHUNK = 4 << 20  # bytes of segments whose transforms are merged together
SHARD = 1 << 16  # symbols of a shard
GROUP = 20_000  # distinct segments of an anchor, about 6 MB, that a task may hold together
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def window_hashes(octets: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width`-byte string, by running sums; equal strings have equal hashes."""
    n = len(octets) - width + 1
    up, down = powers(len(octets))
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * down[: len(octets)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * up[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` numbers in a row, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(text: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`(key, first, last, at)` of the segments, a block of the text at a time.

    A segment is the windows that start at `first` to `last`; its anchor, hashed to `key`, is at `at`.
    """
    octets = np.frombuffer(text, np.uint8)
    for start in range(0, len(text) - window + 1, BLOCK):
        part = octets[start : start + BLOCK + window - 1]
        hashes = window_hashes(part, anchor)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least((hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, window - anchor + 1)
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        yield hashes[at[first]], first + start, last + start, at[first] + start


SEGMENTS = "doc bigint, version bigint, key array<bigint>, content array<bigint>, first array<int>, n array<smallint>, lead array<smallint>"


def find_segments(docs: DataFrame) -> DataFrame:
    """`(doc, version, key, content, first, n, lead)`: windows first to first + n - 1, anchor `lead` bytes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
        for b in batches:
            keep, rows = [], []
            for k, text in enumerate(utf8(b.column(2))):
                parts = list(segments(text))
                if not parts:
                    continue
                key, first, last, at = (np.concatenate(x) for x in zip(*parts))
                lead = at - first
                content = np.fromiter(
                    (xxhash.xxh64_intdigest(text[i : j + WINDOW], s) for i, j, s in zip(first.tolist(), last.tolist(), lead.tolist())),
                    np.uint64, len(first),
                )
                keep.append(k)
                rows.append((key.view(np.int64), content.view(np.int64), first, last - first + 1, lead))
            names = ["doc", "version", "key", "content", "first", "n", "lead"]
            lists = [pa.array([r[c] for r in rows], pa.list_(t)) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], *lists], names=names)

    listed = docs.mapInArrow(frees(run), SEGMENTS)
    columns = ["key", "content", "first", "n", "lead"]
    return listed.select("doc", "version", F.inline(F.arrays_zip(*columns)))


# --- transforms -------------------------------------------------------------------


def load_words(octets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    return octets[at[:, None] + np.arange(8)].view("<u8").ravel()


def repeated_windows(texts: list[bytes], leads: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Per segment, the starts of windows that occur twice or more, weights counted.

    The segments are whole anchor groups: windows are compared in line with the anchors.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    skip = leads % STEP
    lengths = (sizes - skip) // STEP
    symbols = np.frombuffer(b"".join([t[s : s + STEP * m] for t, s, m in zip(texts, skip.tolist(), lengths.tolist())]), "<u8")
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    ends = np.cumsum(lengths)
    shards, at = [], 0
    while at < len(texts):
        begin = ends[at] - lengths[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + SHARD, side="right")))
        shards.append(bwt.build(symbols[begin : ends[stop - 1]], lengths[at:stop], at))
        at = stop
    merged = bwt.merge(shards, window // STEP)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    base = (np.cumsum(sizes) - sizes)[merged.string]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for before in range(STEP):
        depth = (window - before) // STEP
        start = skip[merged.string] + STEP * merged.place - before
        fits = (start >= 0) & (start + window <= sizes[merged.string])
        interval = np.cumsum(merged.shared < depth)
        held = np.bincount(interval[fits], weights=weights[merged.string[fits]], minlength=1)
        spot = np.flatnonzero(fits & (held[np.minimum(interval, len(held) - 1)] >= 2) & (interval < len(held)))
        if not len(spot):
            continue
        # Inside an interval only the bytes around the shared symbols can differ.
        where = base[spot] + start[spot]
        left, right = load_words(flat, where), load_words(flat, where + window - 8)
        tag = mix(left + mix(right + mix(interval[spot].astype(np.uint64))))
        _, group = np.unique(tag, return_inverse=True)
        times = np.bincount(group, weights=weights[merged.string[spot]])
        again = spot[times[group] >= 2]
        order = again[np.argsort(merged.string[again], kind="stable")]
        owner = merged.string[order]
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        for i, j in zip(edge, [*edge[1:], len(owner)] if len(owner) else []):
            out[owner[i]].append(start[order[i:j]])
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def spans_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers as (first, how many)."""
    if not len(starts):
        return starts, starts
    edge = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[edge], np.diff(np.append(edge, len(starts)))


REPEATED = "key bigint, content bigint, skip int, n int"
REPEATED_TYPE = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("skip", pa.int32()), ("n", pa.int32())])


def merge_transforms(distinct: DataFrame) -> DataFrame:
    """`(key, content, skip, n)`: windows of distinct segments that repeat, from `skip` of the segment's first on.

    `distinct` has `(key, content, weight, lead, body)`; repeated rows are skipped. A task takes whole anchor groups, about
    `CHUNK` bytes at a time.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(5))):
                if row[:2] == last:
                    continue  # fetched by each of two equal rows of the table
                last = row[:2]
                if size > CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, content, weight, lead, body = zip(*rows)
        found = repeated_windows(list(body), np.array(lead, np.int64), np.array(weight, np.float64))
        out = []
        for k, c, starts in zip(key, content, found):
            out.extend((k, c, s, n) for s, n in zip(*(x.tolist() for x in spans_of(starts))))
        return batch(REPEATED_TYPE, *(zip(*out) if out else [[]] * 4))

    dealt = distinct.select("key", "content", "weight", "lead", "body").repartition(tasks, "key").sortWithinPartitions("key", "content")
    return dealt.mapInArrow(frees(run), REPEATED)


def count_windows(distinct: DataFrame) -> DataFrame:
    """The same as `merge_transforms`, for anchors of any number of segments: windows by 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "content", "weight", "skip", "h1", "h2"]
        for b in batches:
            for key, content, weight, body in zip(*(b.column(c).to_pylist() for c in range(4))):
                n = len(body) - WINDOW + 1
                digests = b"".join([xxhash.xxh128_digest(body[k : k + WINDOW]) for k in range(n)])
                hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)
                same = [pa.array(np.full(n, x, np.int64)) for x in (key, content, weight)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=names
                )

    kind = "key bigint, content bigint, weight bigint, skip int, h1 bigint, h2 bigint"
    found = materialise(distinct.select("key", "content", "weight", "body").mapInArrow(frees(run), kind))
    often = found.groupBy("key", "h1", "h2").agg(F.sum("weight").alias("times")).where("times > 1")
    often = materialise(often.select("key", "h1", "h2"))  # stored, so that a hot window can be split
    return found.join(often, ["key", "h1", "h2"]).select("key", "content", "skip", F.lit(1).alias("n"))


# --- the operator -----------------------------------------------------------------

LAST = (1 << 63) - 1


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept)` per document; `kept` is what is left, in bytes.

    Cases: a null text is empty; a text shorter than the window loses nothing; a document's own
    repeats count, overlapping ones too; rows that repeat, or share an id, are documents each; an
    empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc.alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    found = materialise(find_segments(named.select("doc", "version", "text")))
    kinds = found.groupBy("key").agg(F.count("*").alias("times"), F.min("content").alias("low"), F.max("content").alias("high"))
    # Stored, so that the join is not tied to the grouping's partitions and a hot anchor can be split.
    shared = materialise(kinds.where("times > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")))
    again = materialise(found.join(shared, "key"))
    alike = again.where(~F.col("mixed")).select("doc", "version", "first", F.col("n").cast("int").alias("n"))
    mixed = again.where("mixed")

    # One occurrence of each distinct segment fetches its bytes. Equal rows of the table give them alike.
    one = mixed.groupBy("key", "content").agg(
        F.count("*").alias("weight"), F.min(F.struct("doc", "version", "first", "n", "lead")).alias("s")
    )
    one = materialise(one)
    crowded = materialise(one.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > group).select("key"))
    merged = merge_transforms(bodies(named, one.join(crowded, "key", "left_anti")))
    if crowded.limit(1).count():
        rest = bodies(named, one.join(crowded, "key", "left_semi")).dropDuplicates(["key", "content"])
        merged = merged.unionByName(count_windows(rest))
    merged = materialise(merged)
    partly = mixed.join(merged.withColumnRenamed("n", "m"), ["key", "content"]).select(
        "doc", "version", (F.col("first") + F.col("skip")).alias("first"), F.col("m").alias("n")
    )
    # Bounded by the document's own bytes.
    gone = alike.union(partly).groupBy("doc", "version").agg(F.collect_set(F.struct("first", "n")).alias("gone"))
    return named.join(gone, ["doc", "version"], "left").select("doc_id", "text", "gone").mapInArrow(
        frees(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def bodies(named: DataFrame, one: DataFrame) -> DataFrame:
    """`(key, content, weight, lead, body)`: the bytes of distinct segments, each from one occurrence."""
    wanted = one.groupBy("s.doc", "s.version").agg(F.collect_list(F.struct("key", "content", "weight", "s.first", "s.n", "s.lead")).alias("segments"))
    return named.select("doc", "version", "text").join(wanted, ["doc", "version"]).mapInArrow(
        frees(fetch), "key bigint, content bigint, weight bigint, lead smallint, body binary"
    )


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted of each document."""
    kind = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("lead", pa.int16()), ("body", pa.binary())])
    for b in batches:
        rows = []
        for text, wanted in zip(utf8(b.column(2)), b.column(3).to_pylist()):
            for s in wanted:
                rows.append((s["key"], s["content"], s["weight"], s["lead"], text[s["first"] : s["first"] + s["n"] - 1 + WINDOW]))
                if len(rows) >= 20_000:
                    yield batch(kind, *zip(*rows))
                    rows = []
        if rows:
            yield batch(kind, *zip(*rows))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the repeated windows' bytes out of each document."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for b in batches:
        rows = []
        gone = b.column(2)
        for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), utf8(b.column(1)))):
            lost, spans, kept = 0, 0, text
            windows = gone[k].values
            if windows is not None and len(windows):
                first, n = (windows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, first, 1)
                np.add.at(step, first + n - 1 + WINDOW, -1)
                covered = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                lost = len(text) - len(kept)
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            rows.append((doc, len(text), lost, spans, kept))
        yield batch(kind, *zip(*rows))
