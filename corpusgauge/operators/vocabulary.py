"""Word vocabulary and token ids.

Texts are split in chunks of bounded size. A chunk lists its distinct words, and only these meet the
vocabulary: a word has one entry a chunk at most, however often it occurs, so no join is skewed by frequent
words. The chunk gets the ids of its list back and splits its texts again; positions are not joined or gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusgauge.operators.joins import may_hash, measured
from corpusgauge.operators.ordering import ranked
from corpusgauge.session import materialise

UNKNOWN_ID = 0  # fixed value: id of a word outside the vocabulary
CHUNK_BYTES = 16 << 20  # text that a task splits at a time, but for a longer row
LEAST_BYTES = 2 << 20  # and as little of it, if that gives work to more tasks
TASKS = 64


def fit_vocab(df: DataFrame, col: str = "text", min_count: int = 1) -> DataFrame:
    """`(word, n, id)`: ids from 1 by falling count, then by word.

    Ids are 32-bit like a model's. A corpus of more than 2^31 distinct words needs a
    `min_count`; rarer words are then unknown.
    """
    return _numbered(df.select(F.col(col).alias("text")).mapInArrow(_count_words, "word string, n bigint"), min_count)


def _numbered(counted: DataFrame, min_count: int) -> DataFrame:
    """The vocabulary from counts `(word, n)` of parts of the text."""
    counts = counted.groupBy("word").agg(F.sum("n").alias("n"))
    if min_count > 1:
        counts = counts.where(F.col("n") >= min_count)
    ids = ranked(counts, F.desc("n"), F.asc("word"), name="rank")
    return ids.select("word", "n", (F.col("rank") + 1).cast("int").alias("id"))


def _split(texts: list[str | None]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words end, and all words in a row."""
    found = [[] if t is None else t.split() for t in texts]  # the same blanks as functions.text.words
    ends = np.cumsum([0, *map(len, found)])
    return ends, pa.array(chain.from_iterable(found), pa.string(), size=int(ends[-1])).dictionary_encode()


def _times(words: pa.DictionaryArray) -> np.ndarray:
    return np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        step = max(batch.num_rows * CHUNK_BYTES // max(texts.nbytes, 1), 1)
        for start in range(0, batch.num_rows, step):
            _, words = _split(texts.slice(start, step).to_pylist())
            yield pa.record_batch([words.dictionary, pa.array(_times(words), pa.int64())], names=["word", "n"])


def _dealt(df: DataFrame, key: str, col: str) -> DataFrame:
    """`(_chunk, _key, _text)`; rows that share a key share a chunk."""
    texts = df.select(F.col(key).alias("_key"), F.col(col).alias("_text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    chunks = max(size // CHUNK_BYTES, min(size // LEAST_BYTES, TASKS)) + 1
    return texts.withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.lit(chunks)).cast("int"))


def _listed(dealt: DataFrame) -> DataFrame:
    """`(_of, spot, word, n)`: each chunk's words with their places in order, whatever the order of its rows."""

    def spell(chunk: tuple, rows: pa.Table) -> pa.Table:
        _, words = _split(rows["_text"].to_pylist())
        order = pc.sort_indices(words.dictionary)
        spots = pa.array(np.arange(len(order)), pa.int32())
        times = pa.array(_times(words)[order.to_numpy()], pa.int64())
        return pa.table({"_of": pa.repeat(chunk[0], len(order)), "spot": spots, "word": words.dictionary.take(order), "n": times})

    return dealt.select("_chunk", "_text").groupBy("_chunk").applyInArrow(spell, "_of int, spot int, word string, n bigint")


def _encoded(dealt: DataFrame, listed: DataFrame, vocab: DataFrame, key: str, size: tuple[int, int, bool] | None) -> DataFrame:
    words = vocab.select("word", "id")
    rows, _, small = size or measured(words)
    many = words.hint("shuffle_hash" if may_hash(dealt.sparkSession, rows) else "merge")
    met = listed.select("_of", "spot", "word").join(F.broadcast(words) if small else many, "word", "left")
    ids = met.select("_of", "spot", F.coalesce(F.col("id").cast("int"), F.lit(UNKNOWN_ID)).alias("id"))

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        ends, words = _split(left["_text"].to_pylist())
        known, mine = np.empty(len(right), np.int32), np.empty(len(right), np.int32)
        known[right["spot"].to_numpy()] = right["id"].to_numpy()
        mine[pc.sort_indices(words.dictionary).to_numpy()] = known
        ids, lengths = mine[words.indices.to_numpy()], np.diff(ends)
        keys = left["_key"].combine_chunks()
        distinct = keys.dictionary_encode(null_encoding="encode")
        if len(distinct.dictionary) < len(keys):
            keys, row = distinct.dictionary, distinct.indices.to_numpy()
            pos = np.arange(len(ids)) - np.repeat(ends[:-1], lengths)
            ids = ids[np.lexsort((ids, pos, np.repeat(row, lengths)))]
            ends = np.cumsum([0, *np.bincount(row, lengths, len(keys)).astype(np.int64)])
        return pa.table({key: keys, "input_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))})

    schema = StructType([StructField(key, dealt.schema["_key"].dataType), *StructType.fromDDL("input_ids array<int>")])
    return dealt.groupBy("_chunk").cogroup(ids.groupBy("_of")).applyInArrow(encode, schema)


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "row_id",
    col: str = "text",
    own: bool = False,
    size: tuple[int, int, bool] | None = None,
) -> DataFrame:
    """`(key, input_ids)`; source columns drop out, a blank text gives an empty array.

    Rows that share a key become one, their words merged by place, then by id. The vocabulary may be the
    corpus' `own` or another's, which makes no difference here; `tokenize_own` fits it as well.
    `size` is the vocabulary's `joins.measured`, for a caller that encodes many tables with it.
    """
    dealt = _dealt(df, key, col)
    return _encoded(dealt, _listed(dealt), vocab, key, size)


def tokenize_own(df: DataFrame, key: str = "row_id", col: str = "text", min_count: int = 1) -> DataFrame:
    """`tokenize` by the vocabulary `fit_vocab` finds in the same texts, from one list of words a chunk."""
    dealt = _dealt(df, key, col)
    listed = materialise(_listed(dealt))
    return _encoded(dealt, listed, _numbered(listed, min_count), key, None)


def tokenize_with(
    df: DataFrame, encode: Callable[[list[str]], list[list[int]]], key: str = "row_id", col: str = "text"
) -> DataFrame:
    """`(key, input_ids)` from a caller's tokenizer, run on Arrow batches in the tasks."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()), index=texts.index)

    return df.select(key, F.pandas_udf(run, "array<int>")(F.col(col)).alias("input_ids"))
