import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import packing
from corpusgauge.llm.queries import public_vocabulary
from oddities import frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(public_vocabulary())


def pack_small(spark, df, capacity=64):
    return packing.pack_documents(df, public_vocabulary(), capacity).toPandas()


def test_ids_offsets_and_capacity(spark, tokenizer):
    got = pack_small(spark, frame(spark))
    want = []
    for row in frame(spark).collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want.append((row["doc_id"], k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    have = [tuple(None if x != x else int(x) for x in r) for r in got[columns].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
        assert part["length"].sum() <= 64


def test_sequences_hold_the_ids(spark):
    df = frame(spark)
    placed = pack_small(spark, df)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(df, public_vocabulary(), 64).collect()}
    assert len(whole) == placed["sequence_id"].nunique()
    assert sum(map(len, whole.values())) == 4 * placed["length"].sum()
    crcs = sorted(placed["ids_crc32"])
    again = []
    for number, part in packing.place(packing.materialise(packing.pieces(df, public_vocabulary(), 64)), 64).toPandas().groupby("sequence_id"):
        again += [zlib.crc32(whole[number][4 * o : 4 * (o + n)]) for o, n in zip(part["offset"], part["length"])]
    assert sorted(again) == crcs


def test_empty_table(spark):
    assert len(pack_small(spark, frame(spark, []))) == 0


def test_many_shards_need_few_more_sequences(spark):
    lengths = np.random.default_rng(3).integers(1, 60, 2000)
    items = packing.materialise(spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "doc_id bigint, length bigint"))
    got = packing.place(items, 64, shard=100).toPandas()
    assert sorted(got["doc_id"]) == list(range(2000))
    assert (got.groupby("sequence_id")["length"].sum() <= 64).all()
    one = len(packing.improve(packing.best_fit(lengths, 64), lengths, 64))
    assert got["sequence_id"].nunique() <= one * 1.03 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_search_keeps_items_and_never_adds_bins(lengths):
    lengths = np.array(lengths, np.int64)
    first = packing.best_fit(lengths, 20)
    better = packing.improve(first, lengths, 20)
    assert sorted(x for b in better for x in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 20 for b in better)
    assert len(better) <= len(first)


def test_an_exchange_empties_a_bin():
    lengths = np.array([6, 4, 5, 5, 3, 7], np.int64)
    bins = [[0], [1, 2], [3, 4], [5]]  # 6, 9, 8, 7 of 10: three bins are enough
    assert len(packing.improve(bins, lengths, 10)) == 3


def test_words_are_encoded_like_texts(tokenizer):
    texts = ["It's  the END, isn't it?\n", "x<|endoftext|>y <|ENDOFTEXT|>", "été dİx  z, 3.14!!! a,b. ,. '", "İstanbul's ß ẞ", "", " \x0b lead\x1c \x85 trail\r\n "]
    found = packing.document_ids(pa.array(texts), packing.WordIds(tokenizer))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_pieces_that_fill_no_bin_end_the_rounds(spark):
    items = packing.materialise(spark.createDataFrame([(k, 40) for k in range(500)], "doc_id bigint, length bigint"))
    got = packing.place(items, 64, shard=50).toPandas()
    assert got["sequence_id"].nunique() == 500 and (got["offset"] == 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_the_unbounded_search_needs_no_more_bins(lengths):
    lengths = np.array(lengths, np.int64)
    first = packing.best_fit(lengths, 30)
    assert len(packing.improve(first, lengths, 30)) <= len(packing.improve(first, lengths, 30, 1, 1))
