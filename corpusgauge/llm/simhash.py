"""SimHash near-duplicates by a generalised pigeonhole with unequal thresholds.

Fingerprints are folded to distinct ones. Bits that go together are put in one partition, as
measured over all distinct fingerprints. If two fingerprints differ in at most `radius` bits and
the partitions' thresholds add up to `radius - partitions + 1`, then in some partition they differ
in at most its threshold; -1 leaves a partition out. Thresholds are chosen by dynamic programming
on the candidates and probes expected of each. A threshold t is probed by masking every choice of
t bits, which is an equi-join key; keys are sorted together and candidates verified by popcount.

A key shared by more than `HEAVY` fingerprints is refined: the bits outside the partition are cut
into `radius + 1` chunks, one of which a linked pair must share. What still meets is searched from
each newly linked fingerprint over those not yet linked, so a tight group settles at once, and only
a spanning forest of each meeting is emitted, not its pairs. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import batch, bounded_batches, extended, frees, fresh, mix, utf8, words
from corpusgauge.llm.graph import components
from corpusgauge.operators.joins import lookup
from corpusgauge.session import materialise

RADIUS = 4
SAMPLE = 2048  # distinct fingerprints from which candidate counts are estimated; steers cost only
HEAVY = 4096  # fingerprints under one key beyond which the key is refined
PROBE_COST, PAIR_COST = 40.0, 1.0  # of a shuffled key against a verified pair
SHORT_RUN = 48  # runs up to this long are compared by lag, all at once

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64, seed 42, of each run of `width` words joined by one blank; fewer words are one run."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    starts = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    n = max(1, len(ws) - width + 1)
    first, last = starts[:n].tolist(), (starts[min(width, len(ws)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(first, last)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in more than half of the hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        octets = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * votes > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """`(doc_id, fp)`; a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(shingle_hashes(t.lower(), width)) for t in utf8(b.column(1))]
            yield batch(FINGERPRINTS, b.column(0), np.array(found, np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frees(run), "doc_id bigint, fp bigint")


# --- choosing partitions and thresholds ------------------------------------------


def bits_of(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def bit_pairs(distinct: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all distinct fingerprints: 64 x 64."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total += x.T @ x
        spot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), pa.array(total.ravel()[spot].astype(np.int64))], names=["spot", "n"])

    rows = distinct.select("fp").mapInArrow(frees(count), "spot int, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(64 * 64)
    for r in rows:
        out[r["spot"]] = r["n"]
    return out.reshape(64, 64)


def group_bits(together: np.ndarray, n: int, parts: int, bits: int = 64) -> list[list[int]]:
    """Partitions of near-equal width, each grown from a bit by those most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = np.ones(bits, bool), []
    for k in range(parts):
        width = int(free.sum()) // (parts - k)
        group = [int(np.argmin(np.where(free, spread, np.inf)))]
        score = np.zeros(bits)
        while True:
            free[group[-1]] = False
            if len(group) == width:
                break
            score += tie[group[-1]]
            group.append(int(np.argmax(np.where(free, score, -1.0))))
        groups.append(sorted(group))
    return groups


def partition_costs(sample: np.ndarray, p: np.ndarray, group: list[int], n: int, radius: int) -> list[float]:
    """Expected work of a partition for thresholds -1 to `radius`: probes and candidate pairs.

    Pairs come from the sample and, where it is too small to see any, from independent bits.
    """
    x = bits_of(sample)[:, group]
    apart = np.bincount((x[:, None, :] != x[None, :, :]).sum(axis=2, dtype=np.int32)[np.triu_indices(len(x), 1)], minlength=radius + 1) if len(x) > 1 else np.zeros(radius + 1)
    seen = np.cumsum(apart) / max(1, len(x) * (len(x) - 1) / 2)
    free = np.zeros(radius + 1)
    free[0] = 1.0
    for q in (2 * p[group] * (1 - p[group])).tolist():
        free = free * (1 - q) + np.concatenate([[0], free[:-1]]) * q
    share = np.maximum(seen[: radius + 1], np.cumsum(free))
    work = [n * comb(len(group), t) * PROBE_COST + comb(len(group), t) * share[t] * n * n / 2 * PAIR_COST for t in range(radius + 1)]
    return [0.0, *work]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (at least -1) adding up to `total` at the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for sum_, (cost, chosen) in best.items():
            for t, more in enumerate(own, start=-1):
                option = (cost + more, [*chosen, t])
                if sum_ + t not in after or option < after[sum_ + t]:
                    after[sum_ + t] = option
        best = after
    return best[total]


def plan(distinct: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The partitions to probe, each with its threshold."""
    n = distinct.count()
    together = bit_pairs(distinct)
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    p = np.diag(together) / max(n, 1)
    best = None
    for parts in range(2, radius + 2):
        groups = group_bits(together, n, parts)
        costs = [partition_costs(sample, p, g, n, radius) for g in groups]
        cost, chosen = allocate(costs, radius - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


# --- probing and verifying --------------------------------------------------------


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def masks(chosen: list[tuple[list[int], int]]) -> list[np.uint64]:
    """The bits each probe compares: a partition without t of its bits."""
    return [_mask(set(group) - set(out)) for group, t in chosen for out in combinations(group, t)]


def chunk_masks(mask: np.uint64, radius: int) -> list[np.uint64]:
    """The bits outside a probe in `radius + 1` chunks."""
    rest = [b for b in range(64) if not int(mask) >> b & 1]
    return [mask | _mask(rest[k :: radius + 1]) for k in range(radius + 1)]


def keys(fps: np.ndarray, probe: int, mask: np.uint64) -> np.ndarray:
    return mix((fps & mask) + mix(np.full(1, probe + 1, np.uint64)))


def linked_runs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys: all pairs of a short run, a spanning forest of a long one."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    run = np.repeat(np.arange(len(edge)), size)
    short = np.where(size <= SHORT_RUN, run[edge], -1)[run]
    a, b = [], []
    for lag in range(1, min(SHORT_RUN, len(key))):
        near = (short[:-lag] == short[lag:]) & (short[lag:] >= 0)
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        a.append(fp[at])
        b.append(fp[at + lag])
    for k in np.flatnonzero(size > SHORT_RUN):
        left = np.unique(fp[edge[k] : edge[k] + size[k]])
        while len(left):
            found, left = [left[0]], left[1:]
            while found and len(left):
                x = found.pop()
                close = np.bitwise_count(left ^ x) <= radius
                if close.any():
                    hits = left[close]
                    a.append(np.full(len(hits), x))
                    b.append(hits)
                    found.extend(hits)
                    left = left[~close]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def find_links(distinct: DataFrame, chosen: list[tuple[list[int], int]], radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """`(a, b)`: linked fingerprints, enough of them to connect every group."""
    spark = distinct.sparkSession
    probes = masks(chosen)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(probes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys(own, k, mask).view(np.int64)), b.column(0), pa.array(np.full(len(own), k, np.int32))],
                    names=["key", "fp", "probe"],
                )

    probed = distinct.select("fp").mapInArrow(frees(probe), "key bigint, fp bigint, probe int")
    counts = probed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    counts = materialise(counts.select("key", F.lit(True).alias("_heavy")))
    # Fewer than probes x fingerprints / heavy keys; broadcast only while that is a small number.
    many = counts.count()
    marked = probed.join(F.broadcast(counts) if many <= 100_000 else counts, "key", "left") if many else probed.withColumn("_heavy", F.lit(None).cast("boolean"))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [chunk_masks(m, radius) for m in probes]
        for b in batches:
            key, own = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            which = b.column(2).to_numpy(zero_copy_only=False)
            is_heavy = np.array(b.column(3).fill_null(False).to_pylist(), bool)
            new_key, new_fp = [key[~is_heavy]], [own[~is_heavy]]
            for k in np.unique(which[is_heavy]):
                mine = own[is_heavy & (which == k)]
                for c, mask in enumerate(chunks[k]):
                    new_key.append(keys(mine, len(probes) + int(k) * (radius + 1) + c, mask))
                    new_fp.append(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (new_key, new_fp)], names=["key", "fp"]
            )

    dealt = marked.select("key", "fp", "probe", "_heavy").mapInArrow(frees(refine), "key bigint, fp bigint")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(tasks, "key").sortWithinPartitions("key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.uint64)
        for b in batches:
            new_key, new_fp = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            key, fp = np.concatenate([key, new_key]), np.concatenate([fp, new_fp])
            # The last run may go on in the next batch.
            cut = np.flatnonzero(key != key[-1])
            cut = cut[-1] + 1 if len(cut) else 0
            if cut > 100_000:
                yield links_of(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links_of(key, fp)

    def links_of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = linked_runs(key, fp, radius)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return batch(LINKS, pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64))

    return together.mapInArrow(frees(verify), "a bigint, b bigint")


def classes(own: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`(fp, n, root)`: every distinct fingerprint of a stored table, its rows, and its group's root."""
    distinct = materialise(own.groupBy("fp").agg(F.count("*").alias("n")))
    links = materialise(find_links(distinct, plan(distinct, radius), radius))
    nodes = components(links).withColumnRenamed("node", "fp")
    return distinct.join(nodes, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """`(doc_id, fp, component_id)` per document: the smallest id reachable over linked fingerprints.

    Cases: a null or blank text has fingerprint zero, which links like any other; documents of one
    fingerprint are one group, however many; a null id gets its group's id but never names one, and
    a group of null ids alone has null; repeated rows are returned each; an empty table gives an
    empty result; columns other than the id and the text are ignored.
    """
    own = materialise(fingerprints(docs, width))
    rooted = classes(own, radius)
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialise(rooted.join(first, "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return lookup(own, rooted.join(names, "root").select("fp", "n", "component_id"), ["fp"], "n", ["doc_id"])


def keep_one(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, one of each near-duplicate group: that of the smallest id, nulls last.

    Cases as for `near_duplicates`; among rows of one id in one group any one stays, so a repeated
    row stays once. Texts without a word are one group.
    """
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    at = columns.index("text")
    fp, row = fresh(docs, "_simhash", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(shingle_hashes(t.lower(), width)) for t in utf8(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*columns, fp])

    marked = docs.mapInArrow(frees(run), extended(docs, f"{fp} bigint")).withColumn(row, F.monotonically_increasing_id())
    marked = materialise(marked)
    own = marked.select(F.col(fp).alias("fp"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(row).alias("row"))
    first = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    firsts = classes(own, radius).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return marked.join(firsts.select(F.col("first.row").alias(row)), row, "left_semi").select(columns)
