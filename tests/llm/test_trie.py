import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, key int, above int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def gathered(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, turn_key(role, text), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(own)] for c, own in out.items()}


def reopened(told):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 6
        return told.get(c - int(np.fmod(c, 100)), [])[:h] + told[c][h:]

    return {c: one(c) for c in told}


def brute(told):
    """Rows of the result from `{conv_id: [(role, text)]}`."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, own in told.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
            if d:
                kids[tuple(own[: d - 1])].add(tuple(own[:d]))

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, own in members.items():
        tree = list(below(p))
        ends = ",".join(str(c) for c in sorted(own) if len(told[c]) == len(p))
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), sum(not kids[q] for q in tree),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def odd_rows():
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody"), (7, None, "user", "null turn"), (7, 0, None, None), (7, 0, "user", "same number"), (7, 0, "a", "same number")]
    hot = [("system", "You are é helpful"), ("user", "hi"), ("assistant", "x" * 3000), ("user", "")]
    for c in [*range(-205, -190), *range(180), *range(400, 520), 10**15 + 1, 10**15 + 4200, 10**15 + 4217]:
        if c == 7 or c == 100:  # no opening for the second hundred
            continue
        own = hot[: rng.randint(0, 4)] if rng.random() < 0.7 else []
        own = own + [(rng.choice(["user", "assistant"]), rng.choice("ab\n")) for _ in range(rng.randint(0, 4))]
        if c == 13:
            own = [("user", str(k)) for k in range(150)]
        if c in (14, 15):
            own = [("user", str(k)) for k in range(90 + c)]
        rows += [(c, k * 3, r, t) for k, (r, t) in enumerate(own)]
    rows.append(rows[5])  # a row twice: one more turn
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def same(got, want):
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("shard_turns", [1 << 16, 60, 1])
def test_equals_brute_force(spark, shard_turns):
    rows = odd_rows()
    same(trie.prefix_trie(trie.sequences(frame(spark, rows).repartition(5)), shard_turns), brute(gathered(rows)))


def test_shared_nodes_of_many_shards(spark):
    rows = [(c, k, "user", str(v)) for c in range(300) for k, v in enumerate([0, 0, 0, c % 3, c % 30, c // 2])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(trie.prefix_trie(trie.sequences(frame(spark, rows))), brute(gathered(rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_rebuilds_conversations(spark):
    rows = odd_rows()
    same(trie.prefix_trie(queries._reopened(trie.sequences(frame(spark, rows)))), brute(reopened(gathered(rows))))


def test_many_ends_are_joined_in_chunks(spark):
    ids = [*range(-5000, 9000, 7), 10**14]
    same(trie.prefix_trie(trie.sequences(frame(spark, [(c, 0, "user", "hi") for c in ids]))), brute({c: [("user", "hi")] for c in ids}))


def test_empty_table(spark):
    assert trie.prefix_trie(trie.sequences(frame(spark, []))).collect() == []
    assert trie.prefix_trie(trie.sequences(frame(spark, [(None, 1, "user", "x")]))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.lists(st.integers(1, 9), max_size=6).map(tuple), min_size=1, max_size=40))
def test_double_array_walks_every_sequence_and_no_other(seqs):
    seqs = sorted(seqs)
    flat = np.array([t for s in seqs for t in s], np.int64)
    built = trie.DoubleArray(flat, np.cumsum([0, *map(len, seqs)]))
    known = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (built.check[: built.end] >= 0).sum() == len(known)
    for s in known:
        state = np.zeros(1, np.int64)
        for turn in s:
            state = built.step(state, np.array([turn]))
        for turn in range(1, 10):
            to = int(built.base[state[0]] + turn)
            inside = 0 < to < built.end and built.check[to] == state[0]
            assert inside == ((*s, turn) in known)
