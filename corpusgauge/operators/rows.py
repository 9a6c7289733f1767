"""Row filters and projections over corpora, generations and histories."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import text as X
from corpusgauge.functions.numbers import nan_to_null
from corpusgauge.operators.ordering import key_range, range_bits, running_offset

BATCH_BYTES = 4 << 20  # of a caller's predicate: texts that a Python task holds at a time, but for a longer one


def strip_nonblank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, X.strip(col)).where(F.col(col) != "")


def min_tokens(df: DataFrame, n: int = 128, ids: str = "input_ids") -> DataFrame:
    return df.where(F.size(ids) >= n)


def min_words(df: DataFrame, n: int = 5, col: str = "text") -> DataFrame:
    return df.where(X.word_count(col) >= n)


def min_chars(df: DataFrame, n: int = 5, col: str = "text") -> DataFrame:
    return df.where(F.length(col) >= n)


def prepare_prompts(df: DataFrame, n: int = 128, col: str = "text", out: str = "prompt") -> DataFrame:
    """First n words of the newline-free text, dropping prompts under five characters."""
    return min_chars(df.withColumn(out, X.first_words(X.newline_to_space(col), n)), 5, out)


def last_word_split(df: DataFrame, col: str = "text") -> DataFrame:
    """Prefix and final word; texts of fewer than two words drop out."""
    words = df.withColumn("_w", X.words(col)).where(F.size("_w") >= 2)
    return words.select(
        *df.columns,
        F.array_join(F.slice("_w", F.lit(1), F.size("_w") - 1), " ").alias("prefix"),
        F.element_at("_w", -1).alias("target"),
    )


def strip_prompt(df: DataFrame, generated: str, prompt: str, out: str = "completion") -> DataFrame:
    return df.withColumn(out, X.strip_prompt(generated, prompt))


def corpus_tokens(
    df: DataFrame,
    key: str,
    col: str = "text",
    separator: str | None = "\n\n",
    bos: str | None = None,
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """`(key, tokens)`: each row's words plus the separator that follows it in the joined text.

    The joined text is never built. A separator made only of spaces yields no token of
    its own; the last row is followed by none. `bos` opens the first row unless there.
    `bounds` are the first and last key, if known.
    """
    tokens = X.words(col)
    first, last = bounds or key_range(df, key)
    if separator is not None and separator.strip(" "):
        tokens = F.when(F.col(key) < F.lit(last), F.concat(tokens, F.array(F.lit(separator)))).otherwise(tokens)
    if bos is not None:
        opens = (F.col(key) == F.lit(first)) & ~F.startswith(F.col(col), F.lit(bos))
        tokens = F.when(opens, F.concat(F.array(F.lit(bos)), tokens)).otherwise(tokens)
    return df.select(key, tokens.alias("tokens"))


def corpus_offsets(
    df: DataFrame, key: str = "row_id", col: str = "text", separator: str = "\n\n", bounds: tuple[int, int] | None = None
) -> DataFrame:
    """`(key, offset, n)`: where each row's tokens start in the joined corpus."""
    bounds = bounds or key_range(df, key)
    tokens = corpus_tokens(df, key, col, separator, bounds=bounds)
    sized = tokens.select(key, F.size("tokens").cast("bigint").alias("n"))
    return running_offset(sized, key, "n", "offset", range_bits(*bounds)).select(key, "offset", "n")


def project(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols)


def metric_or_missing(df: DataFrame, name: str) -> DataFrame:
    """`value` from the named column, missing values dropped; no rows when it is absent."""
    if name not in df.columns:
        return df.select(F.lit(None).cast("double").alias("value")).limit(0)
    return df.select(nan_to_null(F.col(f"`{name}`")).alias("value")).where(F.col("value").isNotNull())


def with_status(df: DataFrame, expr: Column, name: str = "value", error: str = "bad value") -> DataFrame:
    """A failing row becomes a row with its error; `expr` is a try_* expression, null on failure."""
    return df.withColumn(name, expr).withColumn(
        "status", F.when(F.col(name).isNull(), F.lit(f"Error: {error}")).otherwise(F.lit("ok"))
    )


def drop_empty_generations(df: DataFrame, n: str = "n_tokens") -> DataFrame:
    return df.where(F.col(n) > 0)


def drop_warmup(df: DataFrame, flag: str = "is_warmup") -> DataFrame:
    return df.where(~F.col(flag))


def first_logged(df: DataFrame, n: int = 10, index: str = "row_idx") -> DataFrame:
    return df.where(F.col(index) < n)


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Stack outcomes with different columns; absent columns become null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def where_fn(df: DataFrame, fn: Callable[..., pd.Series] | Column, *cols: str) -> DataFrame:
    """Keep rows by a Column, or by a vectorised predicate over the named columns.

    The predicate gets batches of about `BATCH_BYTES`, whatever the length of the texts; the session's
    bound is lowered to that.
    """
    if isinstance(fn, Column):
        return df.where(fn)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.where(F.pandas_udf(fn, "boolean")(*cols))
