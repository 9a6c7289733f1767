"""Corpus length statistics, all read off one small table of length counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import text as X
from corpusgauge.session import materialise


def text_lengths(df: DataFrame, key: str = "row_id", col: str = "text") -> DataFrame:
    """Stripped text with its characters and tokens, both null for a blank row."""
    stripped = X.strip(col)
    return df.select(key, stripped.alias("text")).select(
        key,
        "text",
        F.when(F.col("text") != "", F.length("text")).alias("chars"),
        F.when(F.col("text") != "", X.word_count("text")).alias("tokens"),
    )


def length_counts(lengths: DataFrame) -> DataFrame:
    """Rows and characters per token count: one row per distinct length."""
    return lengths.groupBy("tokens").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))


def corpus_stats(df: DataFrame, key: str = "row_id", col: str = "text") -> DataFrame:
    """Totals, means, extremes and the exact median; the text is read once."""
    counts = length_counts(text_lengths(df, key, col))
    filled = F.col("tokens").isNotNull()
    rows = F.sum(F.when(filled, F.col("rows")))
    return counts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(rows, F.lit(0)).alias("non_empty"),
        F.try_divide(F.sum("chars"), rows).alias("mean_chars"),
        F.try_divide(F.sum(F.col("tokens").cast("bigint") * F.col("rows")), rows).alias("mean_tokens"),
        F.min("tokens").cast("bigint").alias("min_tokens"),
        F.max("tokens").cast("bigint").alias("max_tokens"),
        F.percentile(F.col("tokens"), F.lit(0.5), F.col("rows")).alias("median_tokens"),
    )


def extreme_rows(df: DataFrame, key: str = "row_id", col: str = "text") -> DataFrame:
    """Shortest and longest row by tokens; the first in key order wins a tie."""
    rows = text_lengths(df, key, col).where(F.col("tokens").isNotNull())
    low = F.min(F.struct("tokens", F.col(key).alias("at"), "text"))
    high = F.max(F.struct("tokens", (-F.col(key)).alias("at"), "text"))
    found = rows.agg(low.alias("low"), high.alias("high")).where(F.col("low").isNotNull())
    return found.select(
        F.inline(
            F.array(
                F.struct(F.lit("shortest").alias("which"), F.col("low.at").alias(key), "low.tokens", "low.text"),
                F.struct(F.lit("longest").alias("which"), (-F.col("high.at")).alias(key), "high.tokens", "high.text"),
            )
        )
    )


def count_at_least(df: DataFrame, n: int = 128, key: str = "row_id", col: str = "text") -> DataFrame:
    return text_lengths(df, key, col).agg(F.count_if(F.col("tokens") >= n).alias("n_rows"))


def histogram(df: DataFrame, col: str, bins: int = 50, weight: Column | None = None) -> DataFrame:
    """Equal-width counts `(bin, lo, hi, n)` over [min, max], the last bin closed.

    A constant column is spread over one unit around its value. Every bin is listed.
    """
    spark = df.sparkSession
    values = df.select(F.col(col).cast("double").alias("_x"), (weight if weight is not None else F.lit(1)).alias("_w"))
    values = values.where(F.col("_x").isNotNull())
    bounds = values.agg(F.min("_x").alias("a"), F.max("_x").alias("b"))
    flat = F.col("a") == F.col("b")
    bounds = bounds.select(
        F.struct(
            F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
            F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
        ).alias("bounds")
    )
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(lo + i * step)

    ranged = values.withColumn("_r", bounds.scalar())
    guess = F.least(F.floor((F.col("_x") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    # Dividing may land one bin off where a value meets an edge; the edges decide.
    placed = ranged.withColumn("_g", guess).withColumn(
        "bin",
        F.when(F.col("_x") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("_x") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g")),
    )
    counts = placed.groupBy("bin").agg(F.sum("_w").alias("n"))
    grid = spark.range(bins).select(F.col("id").alias("bin")).withColumn("_r", bounds.scalar())
    return grid.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def length_histogram(df: DataFrame, bins: int = 50, key: str = "row_id", col: str = "text") -> DataFrame:
    """Histogram of token counts, from the table of length counts."""
    counts = materialise(length_counts(text_lengths(df, key, col)))
    return histogram(counts, "tokens", bins, F.col("rows"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def effective_samples(df: DataFrame, limit: int | None) -> DataFrame:
    """How many rows a sample cap really leaves."""
    n = F.count("*")
    return df.agg((n if limit is None else F.least(F.lit(limit), n)).cast("bigint").alias("samples"))
