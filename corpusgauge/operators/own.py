"""Losses of a corpus under its own bigram counts, without a join of its positions.

Rows are dealt to chunks of bounded size. A chunk counts its distinct bigrams and words and deals them,
by a hash, to groups; a group adds up what all chunks sent it, where a bigram has one entry a chunk at
most, however often it occurs, and sends each chunk its totals back. Words travel as 64-bit hashes
beside the words themselves, so that two words of one hash are found; the hash is then changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgauge.functions.text import words
from corpusgauge.operators.joins import attach_narrow
from corpusgauge.operators.ordering import key_range, last_before, range_bits, running_offset
from corpusgauge.operators.rows import corpus_tokens
from corpusgauge.session import materialise

CHUNK_BYTES = 4 << 20  # text that a task counts at a time, but for a longer row
GROUP_BYTES = 4 << 20  # text whose bigrams one task adds up
PLACES = 64
PARTS = ("_text", "_lead", "_trail", "_opens")
ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd number without a pattern

# Packed numbers: hashes of both words and count of each bigram; hash, count as a context and as a token of each word.
COUNTS = "grp int, chunk int, prev binary, token binary, times binary, hashes binary, words array<string>, context binary, seen binary"
TOTALS = "grp int, chunk int, times binary, context binary, new bigint, clashes bigint"


class Chunk:
    """Tokens of a chunk by number, whatever the order of its rows: words by hash, bigrams by group and words."""

    def __init__(self, table: pa.Table, groups: int, salt: int, twins: bool = False):
        found: list[str] = []
        self.sizes, before = [], []
        for text, lead, trail, opens in zip(*(table[c].to_pylist() for c in PARTS), strict=True):
            start = len(found)
            if text is not None:
                if lead is not None:
                    found.append(lead)
                found += text.split()  # the same blanks as functions.text.words
                if trail is not None:
                    found.append(trail)
            self.sizes.append(None if text is None else len(found) - start)
            if len(found) > start:
                before.append((start, opens))
        starts = np.array([start for start, _ in before], np.int64)
        coded = pa.array([*found, *(w for _, w in before)], pa.string()).dictionary_encode(null_encoding="encode")
        numbers, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if words.null_count:  # an unknown word stands before some row; only such entries are null
            nowhere = int(np.flatnonzero(words.is_null().to_numpy(zero_copy_only=False))[0])
            numbers = np.where(numbers == nowhere, -1, numbers - (numbers > nowhere))
            words = words.drop_null()
        tokens, opening = numbers[: len(found)], numbers[len(found) :]
        hashes = word_hashes(words, salt)
        # Words of one group lie together, and so do bigrams below.
        group = (hashes % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((hashes, group))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.word_group = hashes[order], group[order]
        self.words = words.take(pa.array(order))
        self.tokens = rank[tokens]
        self.prev = np.concatenate([[-1], self.tokens[:-1]])[: len(tokens)]
        self.prev[starts] = np.where(opening < 0, -1, rank[opening]) if len(rank) else opening
        self.known = self.prev >= 0
        size = len(rank)
        # What each token is asked for, and what it is told: the bigram, or the token after itself.
        self.told = self.tokens if twins else self.prev
        if twins:
            prev = token = np.arange(size)
            self.which = self.tokens
            times = np.bincount(self.tokens[self.known & (self.prev == self.tokens)], minlength=size)
        else:
            codes = self.prev[self.known] * size + self.tokens[self.known]
            grams, self.which, times = np.unique(codes, return_inverse=True, return_counts=True)
            prev, token = np.divmod(grams, max(size, 1))
        group = ((self.hashes[prev] * ODD + self.hashes[token]) % np.uint64(groups)).astype(np.int64)
        # A stable sort of so few bits counts instead of comparing.
        self.order = np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")
        self.gram_prev, self.gram_token, self.times, self.gram_group = (x[self.order] for x in (prev, token, times, group))

    def counts(self, chunk: int, groups: int) -> pa.Table:
        """A row per group."""
        size, numbers = len(self.words), np.arange(groups + 1)
        context, seen = (np.bincount(x, minlength=size) for x in (self.prev[self.known], self.tokens))
        grams, words = np.searchsorted(self.gram_group, numbers), np.searchsorted(self.word_group, numbers)
        columns = {
            "grp": pa.array(numbers[:-1], pa.int32()),
            "chunk": pa.array(np.full(groups, chunk), pa.int32()),
            "prev": _packed(self.hashes[self.gram_prev], grams),
            "token": _packed(self.hashes[self.gram_token], grams),
            "times": _packed(self.times, grams),
            "hashes": _packed(self.hashes, words),
            "words": pa.ListArray.from_arrays(pa.array(words, pa.int32()), self.words),
            "context": _packed(context, words),
            "seen": _packed(seen, words),
        }
        return pa.table(columns)

    def nll(self, totals: pa.Table, vocab: int, alpha: float) -> pa.Array:
        back = totals.sort_by("grp")
        sent, context = (np.frombuffer(b"".join(back[c].to_pylist()), "<i8") for c in ("times", "context"))
        times = np.empty(len(sent), np.int64)
        times[self.order] = sent
        loss, asked = np.zeros(len(self.tokens)), self.told >= 0
        loss[asked] = -np.log((times[self.which] + alpha) / (context[self.told[asked]] + alpha * vocab))
        return self.lists(pa.array(loss, mask=~asked))

    def lists(self, values: pa.Array) -> pa.Array:
        """One list a row; null for a null text."""
        ends = np.cumsum([0, *(n or 0 for n in self.sizes)])
        offsets = pa.array(ends, pa.int32(), mask=np.array([*(n is None for n in self.sizes), False]))
        return pa.ListArray.from_arrays(offsets, values)


def word_hashes(words: pa.Array, salt: int) -> np.ndarray:
    """A 64-bit hash per word: the sum of random numbers for its bytes at their places."""
    table = np.random.default_rng(salt).integers(0, 1 << 64, (PLACES, 256), np.uint64)
    flat = words.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], "<i8")[flat.offset : flat.offset + len(flat) + 1]
    if not len(flat):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    lap = (2 * (place // PLACES) + 1).astype(np.uint64) * ODD
    starts = np.minimum(offsets[:-1] - offsets[0], max(len(data) - 1, 0))
    sums = np.add.reduceat(table[place % PLACES, data] * lap, starts) if len(data) else np.zeros(len(flat), np.uint64)
    return np.where(lengths > 0, sums, np.uint64(0)) + lengths.astype(np.uint64) * table[0, 0]


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for each stretch between edges, of 8 bytes a number."""
    sides = [pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, values.dtype))]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, *sides])


def _summed(rows: pa.Table) -> tuple[dict, dict, int, int]:
    """What the chunks sent one group, as numbers a chunk; totals beside each entry and which entry stands first
    among its equals; the number of distinct tokens, and of words whose hash is another's."""
    parts = {c: [np.frombuffer(x, "<u8" if c in ("prev", "token", "hashes") else "<i8") for x in rows[c].to_pylist()]
             for c in ("prev", "token", "times", "hashes", "context", "seen")}
    prev, token, times, hashes, context, seen = (np.concatenate(x) for x in parts.values())
    words = rows["words"].combine_chunks().flatten()
    sums = {"times": _totals((prev, token), times), "context": _totals((hashes,), context)}
    first, seen = sums["context"][1], _totals((hashes,), seen)[0]
    spelled = words.dictionary_encode()  # as many words as hashes, unless two words have one hash
    return parts, sums, int((first & (seen > 0)).sum()), len(spelled.dictionary) - int(first.sum())


def add_up(rows: pa.Table) -> pa.Table:
    """Totals of one group, a row for each chunk that sent it something."""
    parts, sums, new, clashes = _summed(rows)
    grams, kept = (np.cumsum([0, *map(len, parts[c])]) for c in ("times", "hashes"))
    once = np.arange(len(rows)) == 0
    columns = {
        "grp": rows["grp"], "chunk": rows["chunk"], "times": _packed(sums["times"][0], grams),
        "context": _packed(sums["context"][0], kept),
        "new": pa.array(np.where(once, new, 0)), "clashes": pa.array(np.where(once, clashes, 0)),
    }
    return pa.table(columns)


def add_up_kinds(rows: pa.Table) -> pa.Table:
    """How many bigrams, and how many contexts, of one group occur n times; with the same two numbers as `add_up`."""
    _, sums, new, clashes = _summed(rows)
    found = {kind: np.unique(total[first], return_counts=True) for kind, (total, first) in sums.items()}
    found |= {"new": (np.zeros(1, np.int64), np.array([new])), "clashes": (np.zeros(1, np.int64), np.array([clashes]))}
    kinds = pa.array([kind for kind, (n, _) in found.items() for _ in n], pa.string())
    n, many = (pa.array(np.concatenate([x[k] for x in found.values()]), pa.int64()) for k in (0, 1))
    return pa.table({"kind": kinds, "n": n, "many": many})


def _totals(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of n over each entry's equals, in the entries' order, and which entry stands first among its equals."""
    order = np.lexsort(keys)
    opens = np.ones(len(order), bool)
    opens[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    starts = np.flatnonzero(opens)
    sums, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    if len(order):
        sums[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff([*starts, len(order)]))
        first[order[starts]] = True
    return sums, first


def own_nll(
    rows: DataFrame,
    text: str = "text",
    lead: Column | None = None,
    trail: Column | None = None,
    opens: Column | None = None,
    alpha: float = 1.0,
    with_tokens: bool = False,
    twins: bool = False,
) -> DataFrame:
    """The other columns of `rows` and `nll`, an array of a loss per token; null where the context is unknown.

    A row's tokens are its words, with `lead` before and `trail` behind them unless null; `opens` stands
    before the first. A null text has none, and a null array. `with_tokens` adds the tokens themselves.
    With `twins` each token is scored as if it stood before itself, and bigrams do not travel at all.
    Rows may be equal. A chunk holds about `CHUNK_BYTES` of text and one row more.
    """
    keep = [c for c in rows.columns if c != text]
    wide, groups = _dealt(rows, text, lead, trail, opens)
    salt = 0
    while True:
        totals, vocab, clashes = _corpus_totals(wide.select("_chunk", *PARTS), groups, salt, twins)
        if not clashes:
            break
        salt += 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = Chunk(left, groups, salt, twins)
        out = left.select(keep).append_column("nll", mine.nll(right, vocab, alpha))
        return out.append_column("tokens", mine.lists(mine.words.take(pa.array(mine.tokens)))) if with_tokens else out

    made = StructType.fromDDL("nll array<double>, tokens array<string>").fields[: 2 if with_tokens else 1]
    schema = StructType([*wide.select(*keep).schema.fields, *made])
    mine = totals.select(F.col("chunk").alias("_chunk"), "grp", "times", "context").groupBy("_chunk")
    return wide.groupBy("_chunk").cogroup(mine).applyInArrow(score, schema)


def _dealt(
    rows: DataFrame, text: str, lead: Column | None, trail: Column | None, opens: Column | None
) -> tuple[DataFrame, int]:
    """Rows with `PARTS` in place of their text and their `_chunk`, and the number of groups."""
    none = F.lit(None).cast("string")
    parts = dict(zip(PARTS, (F.col(text), lead, trail, opens), strict=True))
    keep = [c for c in rows.columns if c != text]
    wide = rows.select(*keep, *[(none if c is None else c).alias(name) for name, c in parts.items()])
    size = wide.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64(*wide.columns), F.lit(size // CHUNK_BYTES + 1)).cast("int")
    return wide.withColumn("_chunk", chunk), size // GROUP_BYTES + 1


def own_ppl(
    rows: DataFrame,
    text: str = "text",
    lead: Column | None = None,
    trail: Column | None = None,
    opens: Column | None = None,
    alpha: float = 1.0,
) -> DataFrame:
    """`(n_tokens, ppl)` over all losses that `own_nll` would give, none of which is worked out.

    The loss is ln(context total) - ln(count), so its sum needs only how many bigrams and how many contexts
    occur how often, and chunks get nothing back.
    """
    wide, groups = _dealt(rows, text, lead, trail, opens)
    texts, salt = wide.select("_chunk", *PARTS), 0
    while True:
        kinds = materialise(_counts(texts, groups, salt, False).groupBy("grp").applyInArrow(add_up_kinds, "kind string, n bigint, many bigint"))
        kinds = kinds.groupBy("kind", "n").agg(F.sum("many").alias("many"))
        vocab, clashes = (kinds.agg(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("many"))), F.lit(0))).first()[0] for k in ("new", "clashes"))
        if not clashes:
            break
        salt += 1
    w, n = F.col("n").cast("double") * F.col("many"), F.col("n")
    sums = kinds.agg(
        F.sum(F.when(F.col("kind") == "times", w)).alias("w"),
        F.sum(F.when(F.col("kind") == "times", w * F.ln(n + F.lit(alpha)))).alias("pairs"),
        F.sum(F.when(F.col("kind") == "context", w * F.ln(n + F.lit(alpha * vocab)))).alias("contexts"),
    )
    tokens = F.when(F.lit(vocab) > 0, F.coalesce(F.round("w").cast("bigint"), F.lit(0)))  # null without any token
    return sums.select(tokens.alias("n_tokens"), F.exp(F.try_divide(F.col("contexts") - F.col("pairs"), "w")).alias("ppl"))


def corpus_ppl(
    rows: DataFrame, key: str, col: str = "text", separator: str = "\n\n", bounds: tuple[int, int] | None = None
) -> DataFrame:
    """`own_ppl` of the joined corpus, as `ngram.corpus_bag` joins it: a separator of spaces is no token, and the
    last word of the nearest row that has one stands before a row."""
    bounds = bounds or key_range(rows, key)
    texts = rows.select(key, col)
    if separator.strip(" "):
        after = F.when(F.col(key) > F.lit(bounds[0]), F.lit(separator))
        return own_ppl(texts, col, None, F.when(F.col(key) < F.lit(bounds[1]), F.lit(separator)), after)
    lasts = materialise(texts.select(key, F.try_element_at(words(col), F.lit(-1)).alias("_last")))
    before = last_before(lasts, key, "_last", "_opens", range_bits(*bounds)).select(key, "_opens")
    placed = attach_narrow(texts, before, key, lasts.count())
    return own_ppl(placed.select(key, col, F.col("_opens").alias("_before")), col, opens=F.col("_before"))


def _counts(texts: DataFrame, groups: int, salt: int, twins: bool) -> DataFrame:
    """A row for each chunk and group."""

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        return Chunk(rows, groups, salt, twins).counts(key[0].as_py(), groups)

    return texts.groupBy("_chunk").applyInArrow(count, COUNTS)


def _corpus_totals(texts: DataFrame, groups: int, salt: int, twins: bool) -> tuple[DataFrame, int, int]:
    """Stored totals for each chunk and group, the number of distinct tokens, and of words whose hash is another's."""
    totals = materialise(_counts(texts, groups, salt, twins).groupBy("grp").applyInArrow(add_up, TOTALS))
    new, clashes = totals.agg(F.coalesce(F.sum("new"), F.lit(0)), F.coalesce(F.sum("clashes"), F.lit(0))).first()
    return totals, new, clashes


def corpus_nll(
    rows: DataFrame,
    key: str,
    col: str = "text",
    separator: str = "\n\n",
    bos: str | None = None,
    bounds: tuple[int, int] | None = None,
    twins: bool = False,
    place_first: bool = False,
) -> tuple[DataFrame, int]:
    """`(key, pos, nll)` of the joined corpus, as `ngram.corpus_stream` places its tokens, and its length.

    The separator is a token, so not one of spaces. Counts are those of `ngram.corpus_bag`, with `place_first`
    those of `ngram.corpus_stream`; they differ only where rows share a key, each of which the stream
    places once per such row.
    """
    bounds = bounds or key_range(rows, key)
    after = F.when(F.col(key) > F.lit(bounds[0]), F.lit(separator))
    trail = F.when(F.col(key) < F.lit(bounds[1]), F.lit(separator))
    lead = None if bos is None else F.when((F.col(key) == F.lit(bounds[0])) & ~F.startswith(F.col(col), F.lit(bos)), F.lit(bos))
    texts = rows.select(key, col)
    if place_first:
        sizes = materialise(corpus_tokens(texts, key, col, separator, bos, bounds).select(key, F.size("tokens").cast("bigint").alias("n")))
    else:
        scored = materialise(own_nll(texts, col, lead, trail, after, twins=twins))
        sizes = scored.select(key, F.size("nll").cast("bigint").alias("n"))
    count, length = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    offsets = running_offset(sizes, key, "n", "offset", range_bits(*bounds)).select(key, "offset")
    if place_first:
        placed = own_nll(attach_narrow(texts, offsets, key, count), col, lead, trail, after, twins=twins)
    else:
        placed = attach_narrow(scored, offsets, key, count)
    flat = placed.select(key, "offset", F.posexplode("nll").alias("pos", "nll"))
    return flat.select(key, (F.col("offset") + F.col("pos")).alias("pos"), "nll"), length
