"""Best-fit packing of tokenised documents, improved by a swap-based local search.

Lengths are packed in shards of bounded size: best fit in decreasing order, then a local search
among underfull bins that moves a piece, exchanges one for one, or two for one, whenever this
raises the sum of squared fills, until bins empty. The few bins a shard leaves open are packed
again together with those of other shards, round by round, so no task ever holds more than a shard.
A search is bounded: it looks at the `RECEIVERS` roomiest bins for a donor and ends after `PATIENCE`
donors that cannot be emptied, at more of both in the last round, over what all shards left open.
Rounds go on while each takes a tenth off the pieces left, so they end.

Cases: a null or empty text is one piece that holds the end id alone; only a document longer than
the capacity is cut; rows that repeat an id or a whole row are packed each; an empty table gives
an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import batch, bounded_batches, frees
from corpusgauge.session import materialise

CAPACITY = 4096
END = 1
SHARD = 16_384  # pieces that a task packs at a time
OPEN_SHARE = 0.02  # a bin with more room than this goes to the next round
LEAST_PROGRESS = 0.1  # share of its pieces that a round must close for another one to follow
CACHED_WORDS = 600_000
BATCH_TEXTS = 4096
TEXT_BYTES = 4 << 20  # more texts at a time share more words
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# Underfull bins looked at for one donor, and donors tried in a row that no exchange helps to empty:
# while there are several shards, and in the last round.
RECEIVERS, PATIENCE = (128, 512), (8, 24)

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


class WordIds:
    """Token ids of each word as little-endian 32-bit numbers, kept for the next texts.

    The vocabulary never joins characters across blanks, so a text's ids are its words' ids. A
    full cache starts anew.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.ids: dict[bytes, bytes] = {b"": b""}
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def of(self, found: list[bytes]) -> list[bytes]:
        """Ids of these words."""
        if len(self.ids) > CACHED_WORDS:
            self.ids = {b"": b""}
        own = list(map(self.ids.get, found))
        new = [k for k, ids in enumerate(own) if ids is None]
        if new:
            self.learn([found[k] for k in new])
            for k in new:
                own[k] = self.ids[found[k]]
        return own

    def learn(self, new: list[bytes]) -> None:
        """Add words. Signs that end a word after a letter are a piece of their own for the vocabulary."""
        pairs, plain = [], set()
        for w in new:
            base = w.rstrip(SIGNS)
            if base is w or base == w:
                plain.add(w)
            elif b"<|" in w:  # may spell a token of its own
                self.spell(w)
            elif base and 97 <= base[-1] <= 122:
                pairs.append((w, base))
                plain.add(base)
                plain.add(w[len(base) :])
            else:
                plain.add(w)
        letters, others = [], []
        for w in plain.difference(self.ids) if pairs else plain:
            text = w.decode()
            if text.isalpha():
                letters.append((w, text))
            elif "<|" in text:
                self.spell(w)
            else:
                others.append((w, text))
        if letters:
            self.add_letters(letters)
        if others:
            self.add_any(others)
        self.ids.update((w, self.ids[base] + self.ids[w[len(base) :]]) for w, base in pairs)


    def spell(self, word: bytes) -> None:
        self.ids[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def add_letters(self, pairs: list[tuple[bytes, str]]) -> None:
        """Words that should be one piece each: encoded together and cut behind each piece's last token."""
        found = self.tokenizer.encode_batch_fast([" ".join([text for _, text in pairs])], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(pairs):  # some letter is spelled by signs of another kind
            self.add_any(pairs)
            return
        self._cut(pairs, ids.tobytes(), [0, *(ends * 4).tolist()])

    def add_any(self, pairs: list[tuple[bytes, str]]) -> None:
        found = self.tokenizer.encode([text for _, text in pairs], is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pairs) + 1)) * 4
        self._cut(pairs, np.array(found.ids, "<u4").tobytes(), ends.tolist())

    def _cut(self, pairs: list[tuple[bytes, str]], ids: bytes, ends: list[int]) -> None:
        self.ids.update((w, ids[i:j]) for (w, _), i, j in zip(pairs, ends, ends[1:]))


def document_ids(texts: pa.Array, cache: WordIds, end: int = END) -> list[bytes]:
    """Each text's token ids and the end id, as little-endian 32-bit numbers.

    The vocabulary knows lower case only, so texts are lowered first, but not where they may spell
    one of its special tokens. Arrow splits the texts and numbers their words, so only distinct
    words are looked up one by one.
    """
    texts = texts.fill_null("")
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    numbered = split.values.dictionary_encode()
    of_word = cache.of(numbered.dictionary.cast(pa.binary()).to_pylist())
    size = np.fromiter(map(len, of_word), np.int32, len(of_word)) // 4
    first = np.cumsum(size, dtype=np.int32) - size
    ids = np.frombuffer(b"".join(of_word), "<u4")
    word = numbered.indices.to_numpy(zero_copy_only=False)
    n = size[word]
    ends = np.zeros(len(n) + 1, np.int32)  # a batch holds fewer than 2^31 ids
    np.cumsum(n, out=ends[1:])
    spot = np.repeat(first[word] - ends[:-1], n)
    spot += np.arange(ends[-1], dtype=np.int32)
    flat = ids[spot]
    edge = ends[split.offsets.to_numpy(zero_copy_only=False)].tolist()
    tail = np.array([end], "<u4").tobytes()
    return [flat[i:j].tobytes() + tail for i, j in zip(edge, edge[1:])]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, ids)`: documents as ids, cut at the capacity.

    `vocabulary` is the tokenizer file's text, which the driver reads and sends along.
    """
    spark = docs.sparkSession
    bounded_batches(spark, TEXT_BYTES)
    sent = spark.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        cache = WordIds(Tokenizer.from_str(sent.value))
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                keys, rows = part.column(0).to_pylist(), []
                for key, ids in zip(keys, document_ids(part.column(1), cache, end), strict=True):
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((key, k, start // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                yield batch(PIECES, *zip(*rows, strict=True))

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        frees(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )
    return out if with_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has exactly r left
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room - need:
            by_room[room - need].append(at)
            rooms |= 1 << (room - need)
    return bins


def _exchange(give: np.ndarray, take: np.ndarray, room: int) -> tuple[list[int], list[int]] | None:
    """Places to swap between a donor and a fuller receiver with `room`: the largest net gain that fits.

    A move is tried first, then one for one, two for one and one for two.
    """
    best, found = 0, None
    fits = np.flatnonzero(give <= room)
    if len(fits):
        k = fits[np.argmax(give[fits])]
        best, found = int(give[k]), ([int(k)], [])
    if best < room and len(take):
        net = give[:, None] - take[None, :]
        net = np.where(net <= room, net, 0)
        i, j = np.unravel_index(np.argmax(net), net.shape)
        if net[i, j] > best:
            best, found = int(net[i, j]), ([int(i)], [int(j)])
    if best < room and len(give) > 1 and len(take):
        p, q = np.triu_indices(len(give), 1)
        net = (give[p] + give[q])[:, None] - take[None, :]
        net = np.where(net <= room, net, 0)
        i, j = np.unravel_index(np.argmax(net), net.shape)
        if net[i, j] > best:
            best, found = int(net[i, j]), ([int(p[i]), int(q[i])], [int(j)])
    if best < room and len(take) > 1:
        p, q = np.triu_indices(len(take), 1)
        net = give[:, None] - (take[p] + take[q])[None, :]
        net = np.where(net <= room, net, 0)
        i, j = np.unravel_index(np.argmax(net), net.shape)
        if net[i, j] > best:
            best, found = int(net[i, j]), ([int(i)], [int(p[j]), int(q[j])])
    return found


def improve(
    bins: list[list[int]], lengths: np.ndarray, capacity: int, most: int | None = None, patience: int | None = None
) -> list[list[int]]:
    """Empty the least filled bins into underfull ones, as far as exchanges lead.

    Without the bounds `most` and `patience`, every underfull bin is a donor and a receiver. Each exchange adds to the fill of a bin that is at least as full as the donor, so the sum of
    squared fills rises with each and the search ends. It stops early at the least possible count.
    """
    bins = [list(b) for b in bins]
    fill = [int(lengths[b].sum()) if b else 0 for b in bins]
    least = -(-sum(fill) // capacity)
    used = sum(1 for b in bins if b)
    tried: set[int] = set()
    while used > least and (patience is None or len(tried) < patience):
        under = [k for k in range(len(bins)) if bins[k] and fill[k] < capacity]
        donor = min((k for k in under if k not in tried), key=lambda k: (fill[k], k), default=None)
        if donor is None:
            break
        tried.add(donor)
        before = used
        receivers = sorted((k for k in under if k != donor and fill[donor] <= fill[k]), key=lambda k: (fill[k], k))
        for k in reversed(receivers[:most]):  # the roomiest, fullest first
            while bins[donor] and fill[donor] <= fill[k] < capacity:
                swap = _exchange(lengths[bins[donor]], lengths[bins[k]], capacity - fill[k])
                if swap is None:
                    break
                out, back = [bins[donor][i] for i in swap[0]], [bins[k][j] for j in swap[1]]
                gain = int(lengths[out].sum() - lengths[back].sum())
                bins[donor] = [x for i, x in enumerate(bins[donor]) if i not in swap[0]] + back
                bins[k] = [x for j, x in enumerate(bins[k]) if j not in swap[1]] + out
                fill[donor], fill[k] = fill[donor] - gain, fill[k] + gain
            if not bins[donor]:
                used -= 1
                break
        if used < before:
            tried.clear()
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset and the bin's fill, for each length; the search is bounded before the last round."""
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    bounds = (RECEIVERS[last], PATIENCE[last])
    for k, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity, *bounds)):
        ends = np.cumsum(lengths[b])
        where[b], offset[b], fill[b] = k, ends - lengths[b], ends[-1]
    return where, offset, fill


def place(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add `sequence_id` and `offset` to a stored table of pieces with a `length`."""
    names = items.columns
    done, left, number, rows = None, items, 0, items.count()
    while True:
        shards = max(1, -(-rows // shard))
        spot = F.pmod(F.xxhash64(*names, F.lit(number)), F.lit(shards))
        fields = [*left.select(names).schema.fields]
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

        first, last = np.int64(number) << 56, shards == 1

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(names, kind="stable", na_position="first", ignore_index=True)
            where, offset, fill = pack_lengths(part["length"].to_numpy(np.int64), capacity, last)
            part["sequence_id"] = first + (part["_shard"].to_numpy(np.int64) << 16) + where
            part["offset"], part["_fill"] = offset, fill
            return part[[*names, "sequence_id", "offset", "_fill"]]

        packed = materialise(
            left.select(*names, spot.alias("_shard")).groupBy("_shard")
            .applyInPandas(pack, f"{kind}, sequence_id bigint, offset bigint, _fill bigint")
        )
        is_open = F.col("_fill") < capacity * (1 - OPEN_SHARE)
        number += 1
        before, rows = rows, packed.where(is_open).count()
        if shards == 1 or rows > before * (1 - LEAST_PROGRESS):
            rest = packed.drop("_fill")
            return rest if done is None else done.unionByName(rest)
        closed = packed.where(~is_open).drop("_fill")
        done = closed if done is None else done.unionByName(closed)
        left = packed.where(is_open).select(*names)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(materialise(pieces(docs, vocabulary, capacity, end)), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """`(sequence_id, ids)`: the packed token sequences, little-endian 32-bit ids.

    A sequence gathers at most `capacity` ids, so no group is unbounded.
    """
    placed = place(materialise(pieces(docs, vocabulary, capacity, end, with_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
