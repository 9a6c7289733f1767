import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusgauge.llm import mixture
from corpusgauge.llm.queries import public_vocabulary
from oddities import documents, frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(public_vocabulary())


def odd_frame(spark):
    rows = documents()
    return frame(spark, [(*r[:3], None if k % 5 == 0 else r[3], *r[4:]) for k, r in enumerate(rows)]).repartition(6)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_every_id_is_packed_once_without_padding(spark, tokenizer):
    df = odd_frame(spark)
    got = mixture.pack(df, public_vocabulary(), 64, 16).toPandas()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(ids_of(tokenizer, r["text"]))) for r in df.collect())
    pieces = defaultdict(int)
    for r in got.itertuples():
        pieces[-1 if r.doc_id != r.doc_id else int(r.doc_id), int(r.doc_tokens)] += r.length
    wanted = defaultdict(int)
    for key in want:
        wanted[key] += key[1]
    assert pieces == wanted
    full = 0
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
        n = part["length"].sum()
        full += n == 64
        assert n <= 64 and n & (n - 1) == 0
    assert full == sum(n for _, n in want) // 64
    by_id = defaultdict(list)
    for r in df.collect():
        by_id[r["doc_id"]].append(ids_of(tokenizer, r["text"]))
    for r in got.itertuples():
        options = by_id[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.ids_crc32 in [zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in options if len(x) == r.doc_tokens]


def test_sequences_hold_the_ids(spark):
    pieces = mixture.materialise(mixture.pack(odd_frame(spark), public_vocabulary(), 64, 16, with_ids=True))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in mixture.sequences(pieces).collect()}
    for r in pieces.collect():
        assert zlib.crc32(whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"]
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in pieces.collect())


def round_robin(queues, quantum, phase, order, unit):
    """Deficit round-robin as a loop: `(row, start, length)` in the order sent. queues: lists of (row, n)."""
    left = {q: [(row, k) for row, n in own for k in range(n)] for q, own in queues.items()}
    deficit, sent = {q: phase[q] * unit for q in queues}, []
    while any(left.values()):
        for q in order:
            deficit[q] += quantum[q]
            while left[q] and deficit[q] >= unit - 1e-9:
                sent += left[q][:unit]
                left[q] = left[q][unit:]
                deficit[q] -= unit
    return sent


@pytest.mark.parametrize("shares", [None, {"src1": 0.5, None: 0.25}])
def test_order_equals_a_loop_over_the_queues(spark, shares):
    tokens = mixture.tokenised(odd_frame(spark), public_vocabulary())
    rows = sorted(tokens.drop("ids").collect(), key=lambda r: r["row"])
    queues = defaultdict(list)
    for r in rows:
        queues[r["queue"]].append((r["row"], r["n"]))
    known = mixture.queues(tokens, 64, shares)
    rates = {r["queue"]: r for r in known.collect()}
    order = [r["queue"] for r in known.selectExpr("queue", "xxhash64(queue) h").distinct().orderBy("h").collect()]
    want = round_robin(queues, {q: r["quantum"] for q, r in rates.items()}, {q: r["phase"] for q, r in rates.items()}, order, 16)
    got = sorted(mixture.stream(tokens, 64, 16, shares).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == np.cumsum([0, *[r["length"] for r in got]])[:-1].tolist()
    assert [(r["row"], k) for r in got for k in range(r["start"], r["start"] + r["length"])] == want


def test_windows_hold_the_mixture(spark):
    df = odd_frame(spark).crossJoin(spark.range(6))
    pieces = mixture.pack(df, public_vocabulary(), 512, 32).where("sequence_id < 100000")
    total = {r["source"]: r["n"] for r in pieces.groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    whole = sum(total.values())
    held = {(r["sequence_id"], r["source"]): r["tokens"] for r in mixture.mixture(pieces).collect()}
    for k in range(whole // 512 - 1):
        for source, n in total.items():
            assert abs(held.get((k, source), 0) - 512 * n / whole) <= 2 * 32


def test_targets(spark):
    df = odd_frame(spark)
    pieces = mixture.pack(df, public_vocabulary(), 512, 32, {"src0": 0.6})
    held = {(r["sequence_id"], r["source"]): r["share"] for r in mixture.mixture(pieces).collect()}
    assert abs(held[0, "src0"] - 0.6) < 0.13 and abs(held[1, "src0"] - 0.6) < 0.13
    with pytest.raises(ValueError):
        mixture.pack(df, public_vocabulary(), 512, 32, {"src0": 0.0})


def test_empty_table(spark):
    assert mixture.pack(frame(spark, []), public_vocabulary()).collect() == []


@given(st.integers(0, 5000), st.sampled_from([1, 7, 64]))
def test_rest_is_cut_into_powers_of_two(total, capacity):
    windows = mixture.Windows(total, capacity)
    cuts = windows.cut([(0, total, 0)]) if total else []
    assert sum(c[1] for c in cuts) == total and [c[3] for c in cuts] == [0] * len(cuts)
    assert all(c[1] == capacity or math.log2(c[1]).is_integer() for c in cuts)
    assert [c[2] for c in cuts] == list(range(len(cuts)))
