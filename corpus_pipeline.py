"""A cleaning pipeline over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import decontaminate, langid, lines, packing, simhash
from corpusgauge.llm.common import fresh
from corpusgauge.llm.queries import public_vocabulary
from corpusgauge.session import delete, scratch_path, scratch_scope

ORACLE_SQL: str | None = None  # hashing, tokenising and packing are beyond SQL; see tests/llm

LEAST_SCORE = 0.3  # share of a text's n-grams that its language must explain
LEAST_LETTERS = 20  # with fewer, a text has too few n-grams to be judged by them


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that the labelled ones teach: without a letter, or scored too low.

    A null or empty text has no letter and goes; one of few letters stays. Repeated rows are judged each.
    """
    pred, score = fresh(docs, "_lang_pred", "_lang_score")
    found = langid.predict(docs, langid.fit(docs), pred=pred, score=score)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    known = (F.col(pred) != langid.UNDETERMINED) & ((F.col(score) >= LEAST_SCORE) | (letters < LEAST_LETTERS))
    return found.where(known).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated three-line windows out of the texts; `n_chars` follows the text. A null text stays null."""
    compared, removed = fresh(docs, "_n_lines", "_n_lines_removed")
    found = lines.dedup_lines(docs, counts=(compared, removed))
    length = F.length("text").cast("bigint")
    return found.select([F.when(F.col(removed) > 0, length).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group: four-word shingles, links at four bits or fewer.

    That of the smallest id, nulls last; texts without a word are one group.
    """
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
