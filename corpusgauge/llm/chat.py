"""Chat formatting over a prefix tree of conversations.

A turn becomes a start mark, the role, a mark, the text and an end mark, as tokens of a public
byte-level vocabulary. Conversations that open with the same turns share them: a node of the tree
is a turn together with all before it. The distinct conversations, as rows of node hashes, are
sorted; sorted order is depth-first order, so a conversation adds the nodes it does not share with
the one before it, and each node's tokens are emitted once. A node has the position id of its
first token (the tokens of the turns before it) and the intervals of the emitted stream that its
ancestors fill, to which attention is allowed beside the node itself.

The sort is a range partitioning, so a first turn that very many share is split like any other
range. Offsets are running sums inside a partition plus one start per partition; the driver sees
the first and last conversation of each partition, whose shared turns were emitted earlier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import bounded_batches, frees
from corpusgauge.operators.joins import lookup
from corpusgauge.session import materialise

START, MIDDLE, STOP = "<|start|>", "<|says|>", "<|stop|>"
LEARNED = "assistant"  # the role whose text is under the loss mask
# Strings that steer one chat template or another. Between the first character and the rest stand
# as many backslashes as the text had, and one more when escaped.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def header(role: str) -> str:
    return START + escape(role) + MIDDLE


TURNS = "array<struct<node:binary,role:string,header:int,body:int,ids:array<int>>>"
TURN_TYPE = pa.list_(pa.struct([
    ("node", pa.binary()), ("role", pa.string()), ("header", pa.int32()), ("body", pa.int32()), ("ids", pa.list_(pa.int32())),
]))


def load_tokenizer(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return tokenizer


def lay_out(turns: DataFrame, vocabulary: str) -> DataFrame:
    """`(conv_id, turns)`: each conversation's turns in order, as nodes and token ids."""
    spark = turns.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    own = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(own.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(sent.value)
        end = tokenizer.encode(STOP, add_special_tokens=False).ids
        heads: dict[str, list[int]] = {}
        for b in batches:
            ids, out = b.column(0), []
            for said in b.column(1).to_pylist():
                node, rows = b"", []
                bodies = tokenizer.encode_batch([escape(t["text"]) for t in said], add_special_tokens=False)
                for t, body in zip(said, bodies):
                    if t["role"] not in heads:
                        if len(heads) > 10_000:
                            heads.clear()
                        heads[t["role"]] = tokenizer.encode(header(t["role"]), add_special_tokens=False).ids
                    head = heads[t["role"]]
                    role, text = t["role"].encode(), t["text"].encode()
                    node = xxhash.xxh128_digest(node + len(role).to_bytes(8, "little") + role + text)
                    rows.append({"node": node, "role": t["role"], "header": len(head), "body": len(body.ids), "ids": head + body.ids + end})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, TURN_TYPE)], names=["conv_id", "turns"])

    return grouped.mapInArrow(frees(run), f"conv_id bigint, turns {TURNS}")


SPANS = "array<struct<start:bigint,stop:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
PLACED = pa.schema([
    ("part", pa.int32()), ("node", pa.binary()), ("n", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("ancestors", SPAN_TYPE),
    ("edge", pa.struct([
        ("first", pa.list_(pa.struct([("node", pa.binary()), ("n", pa.int64())]))),
        ("last", pa.list_(pa.struct([("node", pa.binary()), ("n", pa.int64()), ("start", pa.int64())]))),
        ("total", pa.int64()),
    ])),
])
PLACED_DDL = (
    f"part int, node binary, n bigint, start bigint, position bigint, ancestors {SPANS}, "
    "edge struct<first:array<struct<node:binary,n:bigint>>,last:array<struct<node:binary,n:bigint,start:bigint>>,total:bigint>"
)


def shared(a: list, b: list) -> int:
    """Length of the common prefix."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in spans:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], stop)
        elif stop > start:
            out.append((start, stop))
    return out


def emit_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in depth-first order, places counted from the partition's start; last a row for its edges."""
    part = TaskContext.get().partitionId()
    first: list | None = None
    stack: list[dict] = []  # nodes of the path at hand: node, n, start, position, spans of its ancestors
    total = 0
    for b in batches:
        rows = []
        for path in b.column(0).to_pylist():
            keep = shared([x["node"] for x in stack], [x["node"] for x in path])
            del stack[keep:]
            for x in path[keep:]:
                above = stack[-1] if stack else None
                spans = join_spans([*above["spans"], (above["start"], above["start"] + above["n"])]) if above else []
                position = above["position"] + above["n"] if above else 0
                stack.append({"node": x["node"], "n": x["n"], "start": total, "position": position, "spans": spans})
                rows.append({"part": part, "node": x["node"], "n": x["n"], "start": total, "position": position,
                             "ancestors": [{"start": i, "stop": j} for i, j in spans], "edge": None})
                total += x["n"]
            first = path if first is None else first
        yield pa.RecordBatch.from_pylist(rows, schema=PLACED)
    if first is not None:
        last = [{"node": x["node"], "n": x["n"], "start": x["start"]} for x in stack]
        edge = {"first": [{"node": x["node"], "n": x["n"]} for x in first], "last": last, "total": total}
        yield pa.RecordBatch.from_pylist([{"part": part, "edge": edge}], schema=PLACED)


def resolve(edges: list[tuple[int, dict]]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Per partition, where its own tokens begin, and place and length of the leading nodes emitted before it."""
    out, total, stack = {}, 0, []
    for part, edge in sorted(edges, key=lambda e: e[0]):
        keep = shared([x[0] for x in stack], [x["node"] for x in edge["first"]])
        before = [(start, n) for _, n, start in stack[:keep]]
        skipped = sum(n for _, n in before)
        out[part] = (total, before)
        stack = [
            (x["node"], x["n"], before[k][0] if k < keep and x["start"] < skipped else total + x["start"] - skipped)
            for k, x in enumerate(edge["last"])
        ]
        total += edge["total"] - skipped
    return out


def in_stream(spans: list[tuple[int, int]], base: int, before: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans counted from a partition's start, as spans of the whole stream."""
    skipped = sum(n for _, n in before)
    out: list[tuple[int, int]] = []
    for start, stop in spans:
        at = 0
        for place, n in before:  # nodes of earlier partitions come first
            if start <= at and at + n <= stop:
                out.append((place, place + n))
            at += n
        if stop > skipped:
            out.append((base + max(start - skipped, 0), base + stop - skipped))
    return join_spans(out)


def prefix_tree(laid: DataFrame) -> DataFrame:
    """The emitted stream, one row per node: `(node, start, n, position, ancestors, role, header, body, ids, uses)`.

    `laid` is a stored result of `lay_out`. `start` is the node's place in the stream.
    """
    spark = laid.sparkSession
    path = F.transform("turns", lambda t: F.struct(t["node"].alias("node"), F.size(t["ids"]).cast("bigint").alias("n")))
    paths = laid.select(path.alias("path")).distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.repartitionByRange(tasks, "path").sortWithinPartitions("path")
    placed = materialise(ordered.mapInArrow(frees(emit_sorted), PLACED_DDL))
    edges = [(r["part"], r["edge"].asDict(recursive=True)) for r in placed.where(F.col("edge").isNotNull()).select("part", "edge").collect()]
    known = spark.sparkContext.broadcast(resolve(edges))  # one entry per partition

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                base, before = known.value[r["part"]]
                skipped = sum(n for _, n in before)
                if r["start"] < skipped:
                    continue  # emitted by an earlier partition
                spans = in_stream([(s["start"], s["stop"]) for s in r["ancestors"]], base, before)
                rows.append({"node": r["node"], "start": base + r["start"] - skipped, "n": r["n"], "position": r["position"],
                             "ancestors": [{"start": i, "stop": j} for i, j in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=SETTLED)

    stream = placed.where(F.col("edge").isNull()).drop("edge").mapInArrow(
        frees(settle), f"node binary, start bigint, n bigint, position bigint, ancestors {SPANS}"
    )
    turns = laid.select(F.inline("turns")).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("role", "header", "body", "ids")], F.count("*").alias("uses")
    )
    return stream.join(turns, "node")


SETTLED = pa.schema([("node", pa.binary()), ("start", pa.int64()), ("n", pa.int64()), ("position", pa.int64()), ("ancestors", SPAN_TYPE)])


def format_conversations(turns: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """The emitted stream (see `prefix_tree`), and `(conv_id, place, node)`: each conversation's way through it.

    Cases: a null text or role is empty; turns are ordered by number, then role and text, nulls
    first, so ties have one order; repeated rows are turns each; turns without a conversation id are
    one conversation, whose id is null; an empty table gives empty results; other columns are
    ignored. A conversation is one sequence and is held by one task.
    """
    laid = materialise(lay_out(turns, vocabulary))
    ways = laid.select("conv_id", F.posexplode("turns").alias("place", "t")).select("conv_id", "place", "t.node")
    return materialise(prefix_tree(laid)), ways


def read_back(stream: DataFrame, ways: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of every conversation, decoded from the emitted tokens.

    `(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`. A node that very
    many conversations pass is broadcast or spread; see `joins.lookup`.
    """
    spark = stream.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    found = lookup(ways, stream.select("node", "uses", "role", "header", "body", "ids"), ["node"], "uses", ["conv_id", "place"], stored=False)
    parts = F.array_sort(F.collect_list(F.struct("place", "role", "header", "body", "ids")))
    grouped = found.groupBy("conv_id").agg(parts.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(sent.value)
        for b in batches:
            rows = [digests(tokenizer, turns) for turns in b.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["conv_id", *DIGESTS])

    return grouped.mapInArrow(
        frees(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(tokenizer, turns: list[dict]) -> tuple[int, str, int, str, int]:
    """What the tokens of a conversation say, its marks parsed and its texts unescaped."""
    decode = lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
    ids = [i for t in turns for i in t["ids"]]
    text = decode(ids) if ids else ""
    said, learned, n_learned, n = hashlib.sha256(), hashlib.sha256(), 0, 0
    for piece in text.split(START)[1:]:
        role, body = piece[: -len(STOP)].split(MIDDLE)
        said.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        n += 1
    for t in turns:
        under = np.array(t["ids"], np.int64)[loss_mask(t)].tolist()
        if under:
            own = unescape(decode(under))
            learned.update(own.encode())
            n_learned += len(own)
    return n, said.hexdigest(), n_learned, learned.hexdigest(), len(text)


def loss_mask(node: dict) -> np.ndarray:
    """Which of a node's tokens are learned: those of an assistant's text."""
    mask = np.zeros(len(node["ids"]), bool)
    if node["role"] == LEARNED:
        mask[node["header"] : node["header"] + node["body"]] = True
    return mask
