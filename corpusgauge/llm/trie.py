"""Conversation prefix trie: double-array tries of prefix shards, shared upper nodes merged globally.

A conversation is the row of its turns; a node of the trie is a turn together with all before it.
Equal conversations are folded first, then the distinct ones are range-partitioned and sorted by
their turns, so each partition, and each run of rows of bounded size in it, is a prefix shard: the
subtrees that lie inside it are whole. A shard gives its turns dense ids and packs a double array:
the child of state s by turn t is state BASE[s] + t, whose CHECK is s. All its conversations walk
the arrays side by side, a depth at a time, to count members, and sums run from the deepest states
up along CHECK.

Only nodes on the way to a shard's first or last conversation can have a part in another shard.
Those are open: their parts are added up by node, and sums over subtrees run up the open nodes by
doubling (a node's reach grows from 1 to 2, 4, 8.. levels), in as many joins as the depth has bits.

Cases: a null role or text is an empty one; turns go by `turn`, null first, and those that share a
number by a hash of role and text; rows without a conversation id belong to none; rows may repeat;
a conversation without turns is a member of the root alone; an empty table has no node, not even a
root; other columns are ignored. A conversation's turns, as 32 hash bytes and a length each, meet in
one task, texts do not. A node's list of ended conversations may be most of the table: it is joined in
chunks of at most 4,096 ids, which one task reads in order, as a hash demands, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import batch, bounded_batches, frees
from corpusgauge.operators.joins import lookup
from corpusgauge.session import materialise

SHARD_TURNS = 1 << 16  # turns of distinct conversations in a shard, unless one alone has more
CHUNK_BITS = 12
KEY = 16  # bytes that stand for a turn, or for a node, of its SHA-256
FIRST_CELLS = 256  # cells searched first for a base; then four times as many, and so on
TRIED = 1 << 20  # places tested at a time
ROWS = 1 << 14  # node rows of an Arrow batch
NONE = hashlib.sha256(b"").hexdigest()

NODES = pa.schema([
    ("path", pa.binary()), ("above", pa.binary()), ("is_open", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("size", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()),
])
NODES_DDL = (
    "path binary, above binary, is_open boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "size bigint, n_children bigint, n_leaves bigint, saved bigint"
)
TOTALS = ("n_convs", "n_children", "n_leaves", "saved")


def sequences(turns: DataFrame) -> DataFrame:
    """`(conv_id, turns)`: each conversation's turns in order, as `(key, size)`.

    The key is hex of a hash of role and text, the size the text's code points.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.substring(whole, 1, 2 * KEY).alias("key"), F.char_length(text).alias("size"),
    )
    own = F.sort_array(F.collect_list(F.struct("turn", "key", "size")))
    told = rows.groupBy("conv_id").agg(F.transform(own, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))
    return materialise(told)


class DoubleArray:
    """BASE and CHECK over dense turn ids, packed from sorted distinct sequences. The root is state 0."""

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        self.flat, self.first = flat, first  # all ids; where each sequence starts, and the end
        n = len(flat) + 1
        self.base, self.check = np.zeros(2 * n, np.int64), np.full(2 * n, -1, np.int64)
        self.check[0] = 0
        self.end = self.free = 1  # no state lies at or behind the end, no free cell before `free`
        ids, starts = flat.tolist(), first.tolist()
        stack = [(0, 0, len(starts) - 1, 0)]
        while stack:
            state, low, high, depth = stack.pop()
            if low < high and starts[low] + depth == starts[low + 1]:  # the one that ends here sorts first
                low += 1
            if low == high:
                continue
            labels, edges = [], []
            for row in range(low, high):
                turn = ids[starts[row] + depth]
                if not labels or labels[-1] != turn:
                    labels.append(turn)
                    edges.append(row)
            edges.append(high)
            base = self.place(np.array(labels, np.int64))
            self.base[state] = base
            for turn, a, b in zip(labels, edges, edges[1:]):
                self.check[base + turn] = state
                stack.append((base + turn, a, b, depth + 1))

    def place(self, labels: np.ndarray) -> int:
        """The first base, from the lowest free cell on, with room for all these children."""
        least = int(labels.min())
        ahead = labels - least
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        cell, at, width = self.end, self.free, FIRST_CELLS
        while at < self.end and cell == self.end:
            some = at + np.flatnonzero(self.check[at : min(at + width, self.end)] < 0)
            for part in np.array_split(some, -(-len(some) * len(labels) // TRIED) or 1):
                spots = part[:, None] + ahead
                fits = ((self.check[np.minimum(spots, len(self.check) - 1)] < 0) | (spots >= self.end)).all(axis=1)
                if fits.any():
                    cell = int(part[np.argmax(fits)])
                    break
            at, width = at + width, 4 * width
        top = cell + int(ahead.max()) + 1
        if top > len(self.check):
            more = max(top, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))
        self.end = max(self.end, top)
        return cell - least

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        to = self.base[states] + turns
        if (self.check[to] != states).any():
            raise ValueError("a turn leads out of the trie")
        return to


def shard_nodes(paths: list[bytes], sizes: list[list[int]], counts: list[int], firsts: list[int]) -> list[tuple]:
    """Rows of `NODES` of one shard: sorted distinct paths, their turns' sizes, members and least members."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(p[k : k + KEY], len(number) + 1) for p in paths for k in range(0, len(p), KEY)], np.int64)
    lens = np.array([len(p) // KEY for p in paths], np.int64)
    first = np.concatenate([[0], np.cumsum(lens)])
    trie = DoubleArray(ids, first)
    flat = np.array([n for own in sizes for n in own], np.int64)
    count, least = np.array(counts, np.int64), np.array(firsts, np.int64)
    n, low, size, depth = (np.zeros(trie.end, np.int64) for _ in range(4))
    low[:] = np.iinfo(np.int64).max
    n[0], low[0] = count.sum(), least.min()

    order = np.argsort(-lens, kind="stable")  # those still walking are the first
    state, levels = np.zeros(len(paths), np.int64), []
    for d in range(int(lens.max(initial=0))):
        own = order[: np.searchsorted(-lens[order], -d, side="left")]
        to = trie.step(state[own], ids[first[own] + d])
        state[own] = to
        np.add.at(n, to, count[own])
        np.minimum.at(low, to, least[own])
        size[to], depth[to] = flat[first[own] + d], d + 1
        levels.append(np.unique(to))

    ends = {int(s): hashlib.sha256(p).digest()[:KEY] for s, p in zip(state.tolist(), paths)}
    opened: dict[int, bytes] = {0: hashlib.sha256(b"").digest()[:KEY]}
    for row in {0, len(paths) - 1}:
        at, told = 0, hashlib.sha256()
        for k in range(int(lens[row])):
            at = int(trie.base[at] + ids[first[row] + k])
            told.update(paths[row][k * KEY : (k + 1) * KEY])
            opened[at] = told.copy().digest()[:KEY]

    is_open = np.zeros(trie.end, bool)
    is_open[list(opened)] = True
    children, leaves, saved = (np.zeros(trie.end, np.int64) for _ in range(3))
    for level in reversed(levels):
        own = level[~is_open[level]]
        leaves[own] += children[own] == 0
        saved[own] += (n[own] - 1) * size[own]
        for total, part in ((children, 1), (leaves, leaves[own]), (saved, saved[own])):
            np.add.at(total, trie.check[own], part)
    out = []
    for s in np.concatenate([[0], *levels]).astype(np.int64).tolist():
        up = int(trie.check[s])
        out.append((
            opened.get(s) or ends.get(s), opened.get(up) if s else None, bool(is_open[s]), int(low[s]), int(depth[s]),
            None if not s or is_open[up] else int(low[up]), int(n[s]), int(size[s]), int(children[s]), int(leaves[s]), int(saved[s]),
        ))
    return out


def walk(batches: Iterator[pa.RecordBatch], shard_turns: int = SHARD_TURNS) -> Iterator[pa.RecordBatch]:
    """The nodes of each shard of a sorted partition."""
    held: list[tuple] = []
    turns = 0

    def close() -> Iterator[pa.RecordBatch]:
        rows = shard_nodes(*map(list, zip(*held, strict=True)))
        for at in range(0, len(rows), ROWS):
            yield batch(NODES, *zip(*rows[at : at + ROWS], strict=True))

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = len(row[0]) // KEY
            if held and turns + n > shard_turns:
                yield from close()
                held, turns = [], 0
            held.append(row)
            turns += n + 1
    if held:
        yield from close()


def _digests(rows: DataFrame) -> DataFrame:
    """`(path, ends_sha256)`: a hash of the conversations that end at each node."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = rows.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])
        last, told = None, None
        for b in batches:
            out = []
            for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != last:
                    if told:
                        out.append((last, told.hexdigest()))
                    last, told = path, hashlib.sha256(ids.encode())
                else:
                    told.update(b"," + ids.encode())
            if out:
                yield batch(schema, *zip(*out, strict=True))
        if told:
            yield batch(schema, [last], [told.hexdigest()])

    dealt = chunks.repartition("path").sortWithinPartitions("path", "chunk")
    return dealt.select("path", "ids").mapInArrow(frees(run), "path binary, ends_sha256 string")


def _merged(parts: DataFrame) -> DataFrame:
    """Open nodes with the sums over their subtrees, from their parts in the shards."""
    least = parts.groupBy("path").agg(
        *[F.max(c).alias(c) for c in ("above", "depth", "size")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in TOTALS]
    )
    least = materialise(least)
    kids = least.where("above IS NOT NULL").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("kids"))
    children = F.col("n_children") + F.coalesce("kids", F.lit(0))
    tops = materialise(least.join(kids, "path", "left").select(
        "path", "above", "conv_id", "depth", "n_convs", children.alias("n_children"),
        (F.col("n_leaves") + F.when(children == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.col("above").alias("up"),
    ))
    deepest, reach = tops.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        gain = tops.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("gain"))
        hop = tops.select(F.col("path").alias("up"), F.col("up").alias("next"))
        tops = materialise(tops.join(gain, "path", "left").join(hop, "up", "left").select(
            "path", "above", "conv_id", "depth", "n_convs", "n_children",
            *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "more"), ("saved", "gain"))], F.col("next").alias("up"),
        ))
        reach *= 2
    return tops


def prefix_trie(told: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of `(conv_id, turns)`, as `sequences` makes them.

    `conv_id` is the smallest member, `n_convs` counts members, `n_leaves` the childless nodes of
    the subtree, `saved_tokens` sums (members - 1) x size over it, and `ends_sha256` is of the ids of
    the conversations that end at the node, ascending and joined by commas.
    """
    bounded_batches(told.sparkSession)
    path = F.unhex(F.array_join("turns.key", ""))
    rows = materialise(told.select("conv_id", path.alias("path"), F.col("turns.size").alias("sizes")))
    ended = rows.select("conv_id", F.substring(F.unhex(F.sha2("path", 256)), 1, KEY).alias("path"))
    own = rows.groupBy("path").agg(F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    shards = own.repartitionByRange("path").sortWithinPartitions("path")
    nodes = materialise(shards.mapInArrow(frees(lambda batches: walk(batches, shard_turns)), NODES_DDL))

    tops = _merged(nodes.where("is_open"))
    names = tops.select(F.col("path").alias("above"), F.col("conv_id").alias("top"))
    columns = ["path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    upper = tops.join(names, "above", "left").withColumn("parent_conv_id", F.col("top")).select(columns)
    closed = nodes.where("NOT is_open")
    edge = lookup(closed.where("above IS NOT NULL"), materialise(names), ["above"], None, ["conv_id", "depth"], stored=True)
    edge = edge.withColumn("parent_conv_id", F.col("top")).select(columns)
    found = upper.union(edge).union(closed.where("above IS NULL").select(columns))

    def result(df: DataFrame, ends) -> DataFrame:
        return df.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
            F.coalesce(ends, F.lit(NONE)).alias("ends_sha256"),
        )

    named = result(found.where("path IS NOT NULL").join(_digests(ended), "path", "left"), F.col("ends_sha256"))
    return named.union(result(found.where("path IS NULL"), F.lit(None).cast("string")))
