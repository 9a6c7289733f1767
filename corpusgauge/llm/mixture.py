"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids, its documents one behind the other. A round adds a source's
quantum, its target share of a window, to its deficit, and sends `UNIT` ids whenever the deficit
covers them; what is left is carried into the next rounds. The stream of all rounds is cut into
windows of `CAPACITY`, and documents are cut where a unit or a window ends. Without targets a source's
share is its share of all ids, so that no queue runs dry before the others and every window holds
the mixture of the whole table, up to a unit or two a source. Deficits start spread over the sources,
so that small ones of equal size do not all send in the same round. With targets, a queue that runs
dry leaves its turns to the others.

The round of a unit follows from its place in the queue alone, since the deficit before it is known
from all that was added and sent since the start: this carries deficits over windows and partitions
without a pass from task to task. A place in a queue is a running sum inside a task plus a start per
task and source; the place in the stream is one inside a round plus a start per round.

What does not fill the last window is dealt to sequences of falling powers of two, which need no
padding, so nothing is padded.

Cases: a null or empty text is its end id alone; documents without a source are a queue of their own;
rows that repeat an id or a whole row are packed each; a very long text is packed whole; an empty
table gives an empty result; columns other than the id, the text and the source are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import batch, bounded_batches, frees
from corpusgauge.llm.packing import BATCH_TEXTS, END, TEXT_BYTES, WordIds, document_ids
from corpusgauge.operators.joins import lookup, may_hash
from corpusgauge.operators.ordering import range_bits, running_offset
from corpusgauge.session import materialise

CAPACITY = 2048
UNIT = 256  # ids that a source sends at a time
LEAST_REST = 0.01  # share of a window left to the sources without a target
PHASES = 1 << 20

TOKENS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int32()), ("before", pa.int64()),
    ("n", pa.int64()), ("ids", pa.binary()),
])
TOKENS_DDL = "row bigint, doc_id bigint, queue string, part int, before bigint, n bigint, ids binary"
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
PIECES_DDL = (
    "doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


def tokenised(docs: DataFrame, vocabulary: str, source: str = "source", end: int = END) -> DataFrame:
    """A stored row per document: its ids, its task, and the ids of its queue before it in that task.

    Ids take two bytes if the vocabulary fits, else four; `queue` is the source behind a mark, or
    empty for none.
    """
    spark = docs.sparkSession
    bounded_batches(spark, TEXT_BYTES)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        cache = WordIds(Tokenizer.from_str(sent.value))
        kind = id_type(max(end + 1, len(cache.ends_word)))
        part = TaskContext.get().partitionId()
        row, sent_ids = part << 33, Counter()
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                some, rows = b.slice(at, BATCH_TEXTS), []
                keys, queues = some.column(0).to_pylist(), some.column(2).to_pylist()
                for key, queue, ids in zip(keys, queues, document_ids(some.column(1), cache, end), strict=True):
                    n = len(ids) // 4
                    rows.append((row, key, queue, part, sent_ids[queue], n, np.frombuffer(ids, "<u4").astype(kind).tobytes()))
                    sent_ids[queue] += n
                    row += 1
                yield batch(TOKENS, *zip(*rows, strict=True))

    queue = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", queue.alias("queue"))
    return materialise(named.mapInArrow(frees(run), TOKENS_DDL))


def id_type(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def queues(tokens: DataFrame, capacity: int, shares: dict[str | None, float] | None) -> DataFrame:
    """`(queue, part, ahead, quantum, phase)`: ids of the queue before a task's, its quantum and first deficit."""
    totals = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = materialise(tokens.groupBy("queue").agg(F.sum("n").alias("size")))
    named = {"" if k is None else f"={k}": v for k, v in (shares or {}).items()}
    if any(v <= 0 for v in named.values()):
        raise ValueError("a target share is above zero")
    others = sizes.where(~F.col("queue").isin(list(named))) if named else sizes
    rest = others.agg(F.sum("size")).first()[0] or 1
    share = F.lit(max(LEAST_REST, 1 - sum(named.values()))) * F.col("size") / F.lit(rest)
    for queue, target in named.items():
        share = F.when(F.col("queue") == queue, F.lit(float(target))).otherwise(share)
    phase = F.pmod(F.xxhash64("queue"), F.lit(PHASES)) / F.lit(PHASES)
    rates = sizes.select("queue", (share * capacity).alias("quantum"), phase.alias("phase"))
    return materialise(starts.join(rates, "queue").select("queue", "part", "ahead", "quantum", "phase"))


def stream(tokens: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, shares: dict[str | None, float] | None = None) -> DataFrame:
    """`(row, start, length, position)`: stored pieces of all documents with their place in the stream."""
    narrow = tokens.select("row", "queue", "part", "before", "n")
    known = queues(tokens, capacity, shares)
    placed = lookup(narrow, known, ["queue", "part"], None, ["row"], stored=True)
    first = F.col("ahead") + F.col("before")
    number = F.floor(first / unit)
    last = F.floor((first + F.col("n") - 1) / unit)
    units = placed.select("row", "queue", "n", first.alias("first"), "quantum", "phase", F.explode(F.sequence(number, last)).alias("k"))
    start = F.greatest(F.col("k") * unit - F.col("first"), F.lit(0))
    stop = F.least((F.col("k") + 1) * unit - F.col("first"), F.col("n"))
    due = F.ceil((F.col("k") + 1 - F.col("phase")) * unit / F.col("quantum")) - 1  # the deficit then covers k + 1 units
    cut = materialise(units.select(
        "row", start.alias("start"), (stop - start).alias("length"), due.cast("bigint").alias("round"),
        F.xxhash64("queue").alias("turn"), (F.col("first") + start).alias("at"),
    ))
    rounds = materialise(cut.groupBy("round").agg(F.sum("length").alias("sent")))
    starts = running_offset(rounds, "round", "sent", "began", range_bits(*rounds.agg(F.min("round"), F.max("round")).first()))
    before = Window.partitionBy("round").orderBy("turn", "at", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("length").over(before), F.lit(0))
    joined = cut.join(starts.select("round", "began"), "round")
    return materialise(joined.select("row", "start", "length", (F.col("began") + local).alias("position")))


class Windows:
    """Sequences of a stream: whole windows, then falling powers of two."""

    def __init__(self, total: int, capacity: int):
        self.capacity, self.whole = capacity, total // capacity
        rest, edges = total % capacity, [self.whole * capacity]
        for k in reversed(range(rest.bit_length())):
            if rest >> k & 1:
                edges.append(edges[-1] + (1 << k))
        self.edges = edges

    def spot(self, position: int) -> tuple[int, int, int]:
        """Sequence, offset there, and room from there on."""
        if position < self.edges[0]:
            number, offset = divmod(position, self.capacity)
            return number, offset, self.capacity - offset
        k = bisect_right(self.edges, position) - 1
        return self.whole + k, position - self.edges[k], self.edges[k + 1] - position

    def cut(self, pieces: list[tuple[int, int, int]]) -> list[list[int]]:
        """`[start, length, sequence, offset]` of a document; pieces that adjoin in a sequence are one."""
        out: list[list[int]] = []
        for start, length, position in sorted(pieces):
            while length:
                number, offset, room = self.spot(position)
                n = min(room, length)
                if out and out[-1][2] == number and out[-1][3] + out[-1][1] == offset:
                    out[-1][1] += n
                else:
                    out.append([start, n, number, offset])
                start, length, position = start + n, length - n, position + n
        return out


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, unit: int = UNIT, shares: dict[str | None, float] | None = None,
    source: str = "source", end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    `shares` may give sources a target share of each window; the others split the rest by their size.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, vocabulary, source, end)
    rows, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    windows = Windows(total, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, edges = [], np.cumsum([0, *pc.list_value_length(b.column(4)).to_pylist()]).tolist()
            flat = list(zip(*(c.to_pylist() for c in b.column(4).flatten().flatten()), strict=True))
            for k, (doc_id, queue, n, ids) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)):
                whole = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for start, length, number, offset in windows.cut(flat[edges[k] : edges[k + 1]]):
                    own = whole[4 * start : 4 * (start + length)]
                    out.append((doc_id, queue[1:] if queue else None, start, length, zlib.crc32(own), n, number, offset, own if with_ids else None))
            if out:
                yield batch(PIECES, *zip(*out, strict=True))

    found = stream(tokens, capacity, unit, shares) if rows else None
    if found is None:
        out = spark.createDataFrame([], PIECES_DDL)
    else:
        cuts = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "position")).alias("cuts"))
        cuts = cuts.hint("shuffle_hash" if may_hash(spark, rows) else "merge")
        out = tokens.join(cuts, "row").select("doc_id", "queue", "n", "ids", "cuts").mapInArrow(frees(run), PIECES_DDL)
    return out if with_ids else out.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """`(sequence_id, ids)`: the packed token sequences, little-endian 32-bit ids, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), ""))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def mixture(pieces: DataFrame) -> DataFrame:
    """`(sequence_id, source, tokens, share)`: what each sequence holds of each source."""
    held = pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy("sequence_id"))
    return held.withColumn("share", F.col("tokens") / whole)
