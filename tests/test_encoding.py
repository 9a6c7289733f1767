"""Words encoded chunk by chunk, against the join of their positions."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from corpusgauge.functions import text as X
from corpusgauge.operators import vocabulary

TEXTS = [
    (1, "a b a b c"), (2, ""), (3, None), (4, "a"), (4, "c zz"), (4, None), (5, "b   c\x1cé é é"), (None, "a b"), (None, "b"),
    (6, "</w> a\n\nb  " * 300), (7, "x" * 200 + " " + "x" * 201), (-8, "\x85a\xa0"),
]


def joined_by_position(df, vocab):
    tokens = df.select("row_id", F.posexplode_outer(X.words("text")).alias("pos", "word")).join(vocab.select("word", "id"), "word", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))
    return tokens.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("i")).select("row_id", F.col("i.id").alias("input_ids"))


@pytest.fixture(params=[4 << 20, 16])
def chunks(request, monkeypatch):
    """Everything in one chunk, and dealt over many."""
    monkeypatch.setattr(vocabulary, "CHUNK_BYTES", request.param)
    monkeypatch.setattr(vocabulary, "LEAST_BYTES", request.param)


def by_key(df):
    return sorted(((r["row_id"], list(r["input_ids"])) for r in df.collect()), key=repr)


def test_ids_are_those_of_joined_positions(spark, chunks):
    df = spark.createDataFrame(TEXTS, "row_id int, text string")
    counts = df.select(F.explode(X.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    vocab = vocabulary.fit_vocab(df)
    ordered = sorted(counts, key=lambda r: (-r["n"], r["word"].encode()))
    assert rows_of(vocab, "id", "word", "n") == [(i + 1, r["word"], r["n"]) for i, r in enumerate(ordered)]
    want = by_key(joined_by_position(df, vocab))
    assert by_key(vocabulary.tokenize(df, vocab)) == want
    assert by_key(vocabulary.tokenize_own(df)) == want
    some = vocab.where("n > 1")
    assert by_key(vocabulary.tokenize(df, some)) == by_key(joined_by_position(df, some))
    assert by_key(vocabulary.tokenize_own(df, min_count=2)) == by_key(joined_by_position(df, vocabulary.fit_vocab(df, min_count=2)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id string, text string")
    assert vocabulary.fit_vocab(df).collect() == []
    assert vocabulary.tokenize_own(df).collect() == []


def test_frequent_words_shuffle_one_entry_a_chunk(spark, chunks):
    """Before, each of a text's words was shuffled twice, with its key and place."""
    df = spark.createDataFrame([(i, "the same words " * 50) for i in range(20)], "row_id int, text string")
    assert not [c for c in (vocabulary.tokenize_own(df), vocabulary.tokenize(df, vocabulary.fit_vocab(df))) if "Generate" in plan(c)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
