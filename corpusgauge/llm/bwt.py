"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

Strings are rows of symbols (integers from 1); each is ended by a terminator of its own, which
sorts before all symbols and in the order of the strings. A shard's transform comes from sorting
its own suffixes. Shards are merged without sorting suffixes again: the interleave says, for each
place of the merged order, which shard the next suffix comes from. At first that is shard after
shard. One round reads the shards' transforms in the order of the interleave and sorts the reads
stably by symbol; after k rounds suffixes stand in the order of their first k symbols. Where a
round sets a block apart from the one before it for the first time, their common prefix is k - 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Suffixes of some strings in order: the symbol before each (0: none), its string and its place there."""

    before: np.ndarray
    string: np.ndarray
    place: np.ndarray
    strings: int


def build(symbols: np.ndarray, lengths: np.ndarray, first: int = 0) -> Shard:
    """Transform of the strings laid end to end in `symbols`; `first` is the number of the first."""
    count = len(lengths)
    string = np.repeat(np.arange(count), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    place = np.arange(len(string)) - starts[string]
    text = np.zeros(len(string), np.int64)
    inner = np.ones(len(string), bool)
    inner[ends] = False
    text[inner] = symbols
    rank = np.where(inner, text + count, string)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step, longest = 1, int(lengths.max(initial=0)) + 1
    n = len(text)
    # Doubling; terminators differ, so no comparison reaches beyond a string.
    while step < longest and (n == 0 or rank.max() < n - 1):
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(place > 0, text[np.arange(n) - 1], 0)
    return Shard(before[order], string[order] + first, place[order], count)


def stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable sorting permutation of non-negative integers below 2^32, 16 bits at a time."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if len(codes) and codes.max() >= 1 << 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


@dataclass
class Merged:
    """Suffixes in merged order, and the symbols each shares with the one before it, at most `depth`."""

    string: np.ndarray
    place: np.ndarray
    shared: np.ndarray


def merge(shards: list[Shard], depth: int) -> Merged:
    """The merged order by the first `depth` symbols, with common prefixes up to that length."""
    before = np.concatenate([s.before for s in shards])
    string = np.concatenate([s.string for s in shards])
    place = np.concatenate([s.place for s in shards])
    n = len(before)
    number = np.arange(len(shards), dtype=np.uint16)
    ended = np.repeat(number, [s.strings for s in shards])  # the terminators stay in front
    inter = np.concatenate([ended, np.repeat(number, [len(s.before) - s.strings for s in shards])])
    opens = np.zeros(n, bool)
    opens[:1] = True
    shared = np.where(opens, 0, depth)
    reads = np.empty(n, np.int64)
    for k in range(1, depth + 1):
        reads[np.argsort(inter, kind="stable")] = np.arange(n)
        symbol = before[reads]
        kept = np.flatnonzero(symbol)
        order = kept[stable_order(symbol[kept])]
        block = np.cumsum(opens)
        new = np.ones(n, bool)
        if len(order):
            new[len(ended) + 1 :] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        turned = np.concatenate([ended, inter[order]])
        shared[new & ~opens] = k - 1
        if np.array_equal(turned, inter) and np.array_equal(new, opens):
            break
        inter, opens = turned, new
    reads[np.argsort(inter, kind="stable")] = np.arange(n)
    return Merged(string[reads], place[reads], shared)
