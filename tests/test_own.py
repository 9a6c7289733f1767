"""Losses of a corpus under its own counts: the chunked way against the join of positions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import ngram, own, perplexity
from corpusgauge.plans import model

TEXTS = [
    (1, "a b a b c"), (2, ""), (3, None), (4, "a"), (4, "a"), (5, "b   c\x1cé é é"), (None, "a b"), (6, "</w> a\n\nb " * 300),
    (7, "x" * 200 + " " + "x" * 201),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


@pytest.fixture(params=[4 << 20, 64])
def bytes_(request, monkeypatch):
    """Everything in one chunk and group, and dealt over many."""
    monkeypatch.setattr(own, "CHUNK_BYTES", request.param)
    monkeypatch.setattr(own, "GROUP_BYTES", request.param)


def rounded(df, *cols):
    rows = df.select(*cols, F.round("nll", 9).alias("nll")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_losses_are_those_of_joined_positions(texts, bytes_):
    stream = ngram.row_tokens(texts, "doc_id")
    old = ngram.attach_nll(stream, ngram.seen_nll(ngram.fit_ngram(stream)), ["doc_id", "pos"])
    new = own.own_nll(texts, with_tokens=True)
    flat = new.select("doc_id", F.posexplode(F.arrays_zip("tokens", "nll")).alias("pos", "t")).select("doc_id", "pos", "t.tokens", "t.nll")
    assert rounded(flat, "doc_id", "pos", "tokens") == rounded(old, "doc_id", "pos", "token")
    assert new.where("doc_id = 3 AND nll IS NULL").count() == 1


def test_joined_corpus(texts, bytes_):
    docs = texts.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    stream, n = ngram.corpus_stream(docs, "doc_id")
    scored = ngram.seen_nll(ngram.fit_ngram(ngram.corpus_bag(docs, "doc_id")))
    old = ngram.attach_nll(stream, scored, ["pos"])
    new, length = own.corpus_nll(docs, "doc_id")
    assert length == n
    assert rounded(new, "doc_id", "pos") == rounded(old, "doc_id", "pos")


def test_tokens_scored_after_themselves(texts, bytes_):
    docs = texts.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    counts = ngram.count_ngrams(ngram.corpus_bag(docs, "doc_id", bos="<s>"))
    same = counts.groupBy("token").agg(F.sum("n").alias("n")).select(F.col("token").alias("prev"), "token", "n")
    scored = ngram.score_types(same, ngram.model_from_counts(counts)).drop("prev")
    stream, _ = ngram.corpus_stream(docs, "doc_id", bos="<s>")
    old = ngram.attach_nll(stream.select("pos", "token"), scored, ["pos"])
    new, _ = own.corpus_nll(docs, "doc_id", bos="<s>", twins=True)
    assert rounded(new, "pos") == rounded(old, "pos")


def test_rows_that_share_a_key_count_as_the_stream_places_them(texts):
    docs = texts.where("doc_id IS NULL OR doc_id <> 2")
    stream, n = ngram.corpus_stream(docs, "doc_id")
    old = perplexity.ppl_bigrams(perplexity.weigh_bigrams(stream, perplexity.weight_left(n, 8, 32))).first()
    nll, length = own.corpus_nll(docs, "doc_id", place_first=True)
    new = perplexity.ppl_weighted(nll, perplexity.weight_left(length, 8, 32)).first()
    assert (n, old["n_tokens"], pytest.approx(old["ppl"])) == (length, new["n_tokens"], new["ppl"])
    stream, _ = ngram.corpus_stream(docs, "doc_id", bos="<s>")
    old = perplexity.ppl_own_token(perplexity.weigh_bigrams(stream, perplexity.weight_overlap(8, 32))).first()
    nll, _ = own.corpus_nll(docs, "doc_id", bos="<s>", twins=True, place_first=True)
    new = perplexity.ppl_overlap(nll, 8, 32).first()
    assert (old["n_tokens"], pytest.approx(old["ppl"])) == (new["n_tokens"], new["ppl"])


def test_empty(spark):
    assert own.own_nll(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_words_of_one_hash_are_found():
    row = {"grp": 0, "prev": b"", "token": b"", "times": b"", "hashes": np.array([7], "<u8").tobytes()}
    row |= {"context": np.array([1], "<i8").tobytes(), "seen": np.array([1], "<i8").tobytes()}
    rows = [row | {"chunk": 0, "words": ["a"]}, row | {"chunk": 1, "words": ["b"]}, row | {"chunk": 2, "words": ["a"]}]
    assert sum(own.add_up(pa.Table.from_pylist(rows))["clashes"].to_pylist()) == 1
    assert sum(own.add_up(pa.Table.from_pylist([rows[0], rows[2]]))["clashes"].to_pylist()) == 0
    words = pa.array(["", "ab", "ba", "a" * 64 + "b" + "a" * 64, "b" + "a" * 128, "a" * 129])
    assert len(set(own.word_hashes(words, 0).tolist())) == len(words)
    assert not set(own.word_hashes(words, 0)[1:].tolist()) & set(own.word_hashes(words, 1)[1:].tolist())


@pytest.mark.parametrize("name", ["ngram_nll", "ppl_per_document"])
def test_positions_meet_no_model_in_a_join(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = model.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("separator", [" ", "\n\n"])
def test_perplexity_needs_no_losses(texts, bytes_, separator):
    whole = F.when(F.col("prev").isNotNull(), 1.0).otherwise(0.0)
    for docs in (texts, texts.where("doc_id = 5"), texts.where("doc_id = 4").limit(1), texts.where("doc_id = 2"), texts.where("doc_id < 0")):
        old = perplexity.ppl_bigrams(perplexity.weigh_bigrams(ngram.corpus_bag(docs, "doc_id", separator=separator, bounds=(1, 7)), whole)).first()
        new = own.corpus_ppl(docs, "doc_id", separator=separator, bounds=(1, 7)).first()
        assert (old["n_tokens"], old["ppl"] and pytest.approx(old["ppl"], rel=1e-12)) == tuple(new)
