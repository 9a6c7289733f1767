"""Batches handed to a caller's predicate."""

import pandas as pd
from pyspark.sql import functions as F

from corpusgauge.operators import rows


def test_a_predicate_gets_batches_of_bounded_bytes(spark):
    def few(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum() <= rows.BATCH_BYTES + 100_000] * len(texts))

    texts = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    assert rows.where_fn(texts, few, "text").count() == 400
