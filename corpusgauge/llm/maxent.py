"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class, history). All counted words fill classes, in
order of their counts: the most frequent ones small classes, those after them classes of `SIZE`
times as many words, all others the last class. A class of more than `SIZE` words is divided again,
by a softmax at each step, until one word is chosen, so steps and classes grow with the words.
Features are the previous word, the previous two (an n-gram) and the word before the previous (a
skip); each is hashed to a row of weights, of the class softmax and, with the node, of the softmax
of each further step. Steps below the first of a class see the previous word alone: few histories
reach a node there, and those of two words hardly ever twice. Rows grow with the root of the distinct words. Biases are log counts, so an
untrained model is the unigram model.

Training goes over all training documents once, in `ROUNDS` parts. In each, every task starts from
the same weights, updates them by the gradient of small batches, and emits what changed; changes
are averaged row by row, weighted by how often a task met the row. Word counts cover all training
documents. Hashes and counts of the `KNOWN` most frequent words are sent to the tasks, 16 bytes
each. Where there are more, the others are dealt by hash to buckets, whose number grows with the
root of theirs; a bucket is chosen, and met as history, like a word, and in it a word has its
smoothed share, for which its count is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import bounded_batches, frees, mix, utf8, words
from corpusgauge.session import materialise

CLASSES, SIZE = 32, 32
SMALL, LARGE = 28, 3  # classes of SIZE and of SIZE * SIZE words; the last class holds all other words
KNOWN = 1 << 21  # words whose hashes and counts the tasks hold
BUCKETS = 64  # of the other words, times the root of their number
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 15  # up to ROW_WORDS distinct words; doubled for every fourfold
ROW_WORDS = 1 << 18
FEATURES, DEEP_FEATURES = 3, 1  # the latter below the first step of a class
BLOCK = 256  # weight rows shuffled together
ROUNDS = 2
RATE = 0.3
BATCH = 4096  # tokens of a gradient step
FLUSH = 200_000  # distinct words a task counts before it emits them
LANES = 32  # tasks whose changes of a block are averaged at a time
TASKS_A_CORE = 2  # each task sends a change of the whole model, so tasks follow the cores and not the corpus
TEXT_BYTES = 6 << 20  # more texts at a time share more words
END = b"\n"  # can be no word


# --- counts -----------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """`(word, n)` over all given texts, the end of each included; combined in each task first."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for text in utf8(b.column(0)):
                held.update(words(text.lower()))
                held[END] += 1
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(frees(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def digest(word: bytes) -> int:
    """What Spark's xxhash64 gives."""
    return xxhash.xxh64_intdigest(word, 42)


@dataclass
class Vocabulary:
    """Hashes of the words the tasks know, most frequent first, with their counts; totals of all training tokens.

    `shared` holds tokens and distinct words of each bucket of the other words; one bucket, if not given.
    """

    words: np.ndarray  # given as words, they are hashed
    counts: np.ndarray
    total: int
    distinct: int
    places: tuple[np.ndarray, np.ndarray] | None = None  # hashes in order, and where each word stands
    shared: np.ndarray | None = None

    def __post_init__(self):
        if isinstance(self.words, list):
            self.words = np.array([digest(w) for w in self.words], np.uint64).view(np.int64)
        if self.shared is None:
            self.shared = np.array([self.rest], np.int64)

    @property
    def heads(self) -> int:
        """Words that have a place of their own in a class; buckets follow them."""
        return len(self.words)

    def index(self) -> Vocabulary:
        order = np.argsort(self.words, kind="stable")
        self.places = self.words[order], order.astype(np.int32)
        return self

    def find(self, some: list[bytes]) -> np.ndarray:
        """Places of words, those of their buckets if they are not known."""
        hashed = xxhash.xxh64_intdigest  # as `digest`, without a call in between
        own = np.array([hashed(w, 42) for w in some], np.uint64).view(np.int64)
        spread = self.heads + own % len(self.shared)
        if not self.heads or not len(own):
            return spread
        hashes, order = self.places
        spot = np.minimum(np.searchsorted(hashes, own), self.heads - 1)
        return np.where(hashes[spot] == own, order[spot], spread).astype(np.int64)

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct words without a place of their own."""
        return self.total - int(self.counts.sum()), self.distinct - self.heads

    @property
    def floors(self) -> np.ndarray:
        """What the smoothed counts of each bucket's words, and of one unseen, add up to."""
        return self.shared[:, 0] + 0.5 * (self.shared[:, 1] + 1)


def gathered(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of numbers as arrays; packed by the tasks, so the driver holds eight bytes a number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=b.schema.names)

    cast = df.select([F.col(c).cast("bigint") for c in df.columns])
    rows = cast.mapInArrow(frees(pack), ", ".join(f"{c} binary" for c in df.columns)).collect()
    return [np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[c], np.int64) for r in rows]]) for c in df.columns]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a stored count table: the words down to the least count of which there are `KNOWN` at most.

    The end token is always known. Where a training set has fewer words, all of them are.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    inner = counts.where(F.col("word") != F.lit(END))
    # One row per distinct count, of which a corpus of n tokens has at most sqrt(2 n).
    falling = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    steps = inner.groupBy("n").agg(F.count("*").alias("words")).select("n", F.sum("words").over(falling).alias("words"))
    least = steps.where(F.col("words") <= KNOWN).agg(F.min("n")).first()[0]
    chosen = (F.col("word") == F.lit(END)) | (F.col("n") >= (total + 1 if least is None else least))
    words, n = gathered(counts.where(chosen).select(F.xxhash64("word").alias("word"), "n"))
    order = np.lexsort((words, -n))
    others = distinct - len(words)
    buckets = max(1, min(others, int(BUCKETS * others**0.5)))
    shared = np.zeros((buckets, 2), np.int64)
    if others:
        bucket = F.pmod(F.xxhash64("word"), F.lit(buckets).cast("bigint")).alias("bucket")
        own = gathered(counts.where(~chosen).groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("words")))
        shared[own[0]] = np.stack(own[1:], axis=1)
    return Vocabulary(words[order], n[order], int(total), int(distinct), shared=shared).index()  # once, not in every task


# --- model ------------------------------------------------------------------------


@dataclass
class Model:
    class_bias: np.ndarray  # CLASSES
    word_bias: np.ndarray  # a row of SIZE for each node below the classes
    class_rows: np.ndarray
    word_rows: np.ndarray


def regions(places: int) -> list[tuple[int, int, int, int]]:
    """`(first place, end, steps below the class, first class)` of the classes of each kind."""
    small, large = SMALL * SIZE, LARGE * SIZE * SIZE
    steps = 1
    while SIZE**steps < places - small - large:
        steps += 1
    edges = [(0, small, 1, 0), (small, small + large, 2, SMALL), (small + large, places, steps, SMALL + LARGE)]
    return [(start, min(end, places), n, first) for start, end, n, first in edges if start < places]


def first_nodes(places: int) -> list[list[int]]:
    """Number of the first node of each region's steps, the last step's first."""
    out, n = [], 0
    for start, end, steps, _ in regions(places):
        out.append([])
        for k in range(1, steps + 1):
            out[-1].append(n)
            n += -(-(end - start) // SIZE**k)
    return out


def grown(rows: int, distinct: int) -> int:
    while distinct > ROW_WORDS:
        rows, distinct = rows * 2, distinct // 4
    return rows


def untrained(v: Vocabulary) -> Model:
    mass = np.concatenate([v.counts + 0.5, v.floors])
    classes, nodes = np.zeros(CLASSES), []
    for start, end, steps, first in regions(len(mass)):
        own = mass[start:end]
        for _ in range(steps):
            own = np.pad(own, (0, -len(own) % SIZE)).reshape(-1, SIZE)
            nodes.append(own)
            own = own.sum(axis=1)
        classes[first : first + len(own)] = own
    with np.errstate(divide="ignore"):
        bias, word = np.log(classes), np.log(np.concatenate(nodes))
    return Model(
        (bias - bias.max()).astype(np.float32), (word - word.max(axis=1, keepdims=True)).astype(np.float32),
        np.zeros((grown(CLASS_ROWS, v.distinct), CLASSES), np.float32), np.zeros((grown(WORD_ROWS, v.distinct), SIZE), np.float32),
    )


@dataclass
class Tokens:
    """Texts as places of their tokens, tokens per text; their words, where each text's begin, which are known."""

    places: np.ndarray
    lengths: np.ndarray
    words: pa.Array
    edges: np.ndarray
    seen: np.ndarray


def tokenize(texts: pa.Array, v: Vocabulary) -> Tokens:
    """Words by Arrow, numbered so that only distinct ones are looked up; each text ends with the end token."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    filled = pc.greater(pc.binary_length(split.values), 0)  # blanks at a text's ends leave empty words
    own = split.values.filter(filled)
    edges = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy(zero_copy_only=False)]
    numbered = own.dictionary_encode()
    known = v.find(numbered.dictionary.cast(pa.binary()).to_pylist())
    found = known[numbered.indices.to_numpy(zero_copy_only=False)]
    lengths = np.diff(edges) + 1
    places = np.full(len(found) + len(lengths), v.find([END])[0])
    inner = np.ones(len(places), bool)
    inner[np.cumsum(lengths) - 1] = False
    places[inner] = found
    return Tokens(places, lengths, own, edges, found < v.heads)


def feature_hashes(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(FEATURES, n) hashes of each token's history; before a text's first word stands a mark."""
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[0], places[:-1]]) + 3
    before[starts] = 1
    second = np.concatenate([[0], before[:-1]])
    second[starts] = 1
    a, b = before.astype(np.uint64), second.astype(np.uint64)
    return np.stack([mix(a * np.uint64(3)), mix((a << np.uint64(32)) + b * np.uint64(3) + np.uint64(1)), mix(b * np.uint64(3) + np.uint64(2))])


def rows_of(hashes: np.ndarray, model: Model) -> np.ndarray:
    """Weight rows of the class softmax."""
    return (hashes % np.uint64(len(model.class_rows))).astype(np.int64)


def node_rows(hashes: np.ndarray, node: np.ndarray, model: Model) -> np.ndarray:
    """Weight rows of the softmax of the given nodes."""
    return (mix(hashes + node.astype(np.uint64) + np.uint64(1)) % np.uint64(len(model.word_rows))).astype(np.int64)


def logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(weights, r, axis=0)
    out += bias
    return out


LARGEST = np.float32(80)  # biases are at most 0 and weights a few units, so this holds for sums of exponentials


def exponentials(x: np.ndarray) -> np.ndarray:
    """In place; returns each row's sum, which over short rows `einsum` adds up quickest."""
    if x.size and x.max() > LARGEST:
        np.minimum(x, LARGEST, out=x)
    np.exp(x, out=x)
    return np.einsum("ij->i", x)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    total = exponentials(x)
    x *= (1 / total)[:, None]
    return x


def log_chance(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax at each row's target; `x` is used up."""
    own = np.minimum(x[np.arange(len(target)), target], LARGEST).astype(np.float64)
    return own - np.log(exponentials(x).astype(np.float64))


def split_places(places: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Class of each token; then of the first steps below, and of all further ones, the token, the node and what is chosen there."""
    leaves = v.heads + len(v.shared)
    places = np.where(places < 0, v.heads, places)
    cls, top, deep = np.zeros(len(places), np.int64), [], []
    for (start, end, steps, first), nodes in zip(regions(leaves), first_nodes(leaves)):
        at = np.flatnonzero((places >= start) & (places < end))
        own = places[at] - start
        for k in range(steps):
            slot, own = own % SIZE, own // SIZE
            (top if k == steps - 1 else deep).append((at, nodes[k] + own, slot))
        cls[at] = first + own
    none = np.zeros(0, np.int64)
    return cls, [tuple(map(np.concatenate, zip(*x))) if x else (none, none, none) for x in (top, deep)]


def feature_count(kind: int) -> int:
    return DEEP_FEATURES if kind else FEATURES


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted, and where each stood: one sort of plain numbers that hold both."""
    bits = len(rows).bit_length()
    packed = np.sort(rows << bits | np.arange(len(rows)))
    return packed >> bits, packed & ((1 << bits) - 1)


class Trainer:
    """Updates one task's copy of the weights and keeps count of the rows it met."""

    def __init__(self, model: Model, v: Vocabulary):
        self.v = v
        self.model = Model(model.class_bias, model.word_bias, model.class_rows.copy(), model.word_rows.copy())
        self.met = [np.zeros(len(rows), np.float32) for rows in (model.class_rows, model.word_rows)]

    def step(self, places: np.ndarray, hashes: np.ndarray) -> None:
        m = self.model
        cls, steps = split_places(places, self.v)
        self._update(m.class_rows, 0, m.class_bias, rows_of(hashes, m), cls)
        for kind, (which, node, slot) in enumerate(steps):
            if len(which):
                mine = hashes[: feature_count(kind), which]
                self._update(m.word_rows, 1, m.word_bias[node], node_rows(mine, node, m), slot)

    def _update(self, weights: np.ndarray, kind: int, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        grad = softmax(logits(bias, weights, rows))
        grad[np.arange(len(target)), target] -= 1
        grad *= np.float32(RATE / np.sqrt(2))  # what a row met once moves by
        for r in rows:
            own, order = in_order(r)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            n = np.diff(np.append(starts, len(r)))
            once = n == 1
            row, spot = own[starts[once]], order[starts[once]]
            weights[row] = np.take(weights, row, axis=0) - np.take(grad, spot, axis=0)
            self.met[kind][row] += 1
            if once.all():
                continue
            often, row = n[~once].astype(np.float32), own[starts[~once]]
            total = np.add.reduceat(np.take(grad, order[np.repeat(~once, n)], axis=0), np.cumsum(n[~once]) - n[~once], axis=0)
            total *= (np.sqrt(2) / np.sqrt(often * (1 + often))).astype(np.float32)[:, None]
            weights[row] = np.take(weights, row, axis=0) - total
            self.met[kind][row] += often

    def changes(self, start: Model) -> Iterator[tuple[int, bytes, bytes]]:
        """`(block, met, change)` of the blocks that were met; word blocks follow the class blocks."""
        first = 0
        for met, mine, old in zip(self.met, (self.model.class_rows, self.model.word_rows), (start.class_rows, start.word_rows)):
            for k in range(0, len(met), BLOCK):
                if met[k : k + BLOCK].any():
                    change = (mine[k : k + BLOCK] - old[k : k + BLOCK]).astype(np.float16)
                    yield first + k // BLOCK, met[k : k + BLOCK].tobytes(), change.tobytes()
            first += len(met) // BLOCK


def average(part: pd.DataFrame) -> pd.DataFrame:
    """Changes of a block, weighted by how often each task met the row."""
    part = part.sort_values("task", kind="stable")
    met = np.stack([np.frombuffer(x, np.float32) for x in part["met"]]).astype(np.float64)
    change = np.stack([np.frombuffer(x, np.float16).reshape(BLOCK, -1) for x in part["change"]]).astype(np.float64)
    total = met.sum(axis=0)
    mean = (change * met[:, :, None]).sum(axis=0) / np.maximum(total, 1)[:, None]
    first = part.iloc[0]
    return pd.DataFrame({
        "block": [first["block"]], "lane": [first["lane"]], "task": [first["task"]],
        "met": [total.astype(np.float32).tobytes()], "change": [mean.astype(np.float16).tobytes()],
    })


CHANGES = "block int, lane int, task int, met binary, change binary"


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """One pass over all documents, `rounds` averages on the way."""
    spark = docs.sparkSession
    bounded_batches(spark, TEXT_BYTES)
    model = untrained(v)
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    lanes = -(-tasks // LANES)
    for part in range(rounds):
        sent = spark.sparkContext.broadcast((v, model))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, start = sent.value
            if known.places is None:
                known.index()
            own = Trainer(start, known)
            for b in batches:
                t = tokenize(b.column(0), known)
                hashes = feature_hashes(t.places, t.lengths)
                for k in range(0, len(t.places), BATCH):
                    own.step(t.places[k : k + BATCH], hashes[:, k : k + BATCH])
            task = TaskContext.get().partitionId()
            for block, met, change in own.changes(start):
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "lane": task % lanes, "task": task, "met": met, "change": change}], schema=CHANGE_ROWS
                )

        mine = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == part).select("text")
        changed = mine.coalesce(tasks).mapInArrow(frees(run), CHANGES)
        if lanes > 1:
            changed = changed.groupBy("block", "lane").applyInPandas(average, CHANGES)
        averaged = changed.groupBy("block").applyInPandas(average, CHANGES).select("block", "change").collect()
        # At most all weights once, whatever the corpus.
        class_blocks = len(model.class_rows) // BLOCK
        for r in averaged:
            table, k = (model.class_rows, r["block"]) if r["block"] < class_blocks else (model.word_rows, r["block"] - class_blocks)
            table[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(r["change"], np.float16).reshape(BLOCK, -1).astype(np.float32)
        sent.unpersist()
    return model


CHANGE_ROWS = pa.schema([("block", pa.int32()), ("lane", pa.int32()), ("task", pa.int32()), ("met", pa.binary()), ("change", pa.binary())])


# --- scores -----------------------------------------------------------------------


def token_scores(places: np.ndarray, lengths: np.ndarray, v: Vocabulary, model: Model) -> np.ndarray:
    """Natural log probability of each token; of a word not known, that of its bucket only."""
    out = np.zeros(len(places))
    hashes = feature_hashes(places, lengths)
    for k in range(0, len(places), BATCH):
        mine = hashes[:, k : k + BATCH]
        cls, steps = split_places(places[k : k + BATCH], v)
        score = log_chance(logits(model.class_bias, model.class_rows, rows_of(mine, model)), cls)
        for kind, (which, node, slot) in enumerate(steps):
            if len(which):
                rows = node_rows(mine[: feature_count(kind), which], node, model)
                score += np.bincount(which, log_chance(logits(model.word_bias[node], model.word_rows, rows), slot), len(cls))
        out[k : k + BATCH] = score
    return out


SCORED = "n_tokens bigint, n_known bigint, base double, model double, unknown array<binary>"


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """`(doc_id, n_tokens, n_known, train_tokens, base_score, score)` of every document, in log10."""
    spark = docs.sparkSession
    bounded_batches(spark, TEXT_BYTES)
    sent = spark.sparkContext.broadcast((v, model))
    floor = np.log10(v.total + 0.5 * (v.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        if known.places is None:
            known.index()
        # Of a word not known, the base waits for its count, as its share of the bucket does.
        base_of = np.concatenate([np.log10(known.counts + 0.5) - floor, np.zeros(len(known.shared))])
        bucket_of = np.log10(known.floors)
        for b in batches:
            t = tokenize(b.column(1), known)
            starts = np.cumsum(t.lengths) - t.lengths
            seen = t.places < known.heads
            each = base_of[t.places]
            scores = token_scores(t.places, t.lengths, known, weights) / np.log(10)
            waits = ~seen
            waits[starts + t.lengths - 1] = False  # without training the end is not known, and certain
            scores[waits] -= bucket_of[t.places[waits] - known.heads]
            sums = [np.add.reduceat(x, starts) for x in (seen.astype(np.int64), each, scores)]
            rare = t.words.filter(pa.array(~t.seen)).cast(pa.binary())
            edge = np.concatenate([[0], np.cumsum(~t.seen)])[t.edges].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(t.lengths), *[pa.array(s) for s in sums], pa.ListArray.from_arrays(pa.array(edge), rare)],
                names=["doc_id", "n_tokens", "n_known", "base", "model", "unknown"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frees(run), f"doc_id bigint, {SCORED}")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    # Words not among the known are light keys, or not in the training at all; a hot one is split by adaptive execution.
    rare = rows.select("row", F.explode("unknown").alias("word")).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("row").agg(
        F.count_if(c > 0).alias("known"), F.count("*").alias("n"), F.sum(F.log10(c + 0.5)).alias("logs")
    )
    joined = rows.drop("unknown").join(more, "row", "left")
    n, logs = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("logs"), F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - n * F.lit(float(floor))).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def fit_and_score(docs: DataFrame, training: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of `docs` under a model of `training` (both `doc_id, text`).

    Cases: a null or empty text is the end token alone; a word the training lacks has count zero;
    without training documents every token has probability one; rows that repeat are scored and
    learned from each; an empty table gives an empty result; other columns are ignored.
    """
    training = training.select("doc_id", "text")
    counts = materialise(count_words(training))
    v = vocabulary(counts)
    return score(docs.select("doc_id", "text"), counts, v, train(training, v, rounds))
