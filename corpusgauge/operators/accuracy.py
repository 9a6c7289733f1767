"""Token, last-word and pass@k accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import words


def token_accuracy(df: DataFrame, pred: str = "pred", label: str = "label", weight: str | None = None) -> DataFrame:
    """Share of labels predicted; `weight` counts rows that stand for many positions."""
    w = F.col(weight) if weight else F.lit(1)
    hit = F.when(F.col(pred) == F.col(label), w).otherwise(0)
    return df.where(F.col(label).isNotNull()).agg(
        F.sum(w).cast("bigint").alias("n_labels"),
        F.try_divide(F.sum(hit).cast("double"), F.sum(w)).alias("accuracy"),
    )


def best_accuracy(counts: DataFrame, by: str = "token", weight: str = "n") -> DataFrame:
    """`token_accuracy` of predicting each token's most frequent label, from counted distinct pairs.

    The predicted label is hit as often as its pair occurs, so predictions are not joined to the pairs.
    """
    best = counts.groupBy(by).agg(F.max(weight).alias("_hit"), F.sum(weight).alias("_all"))
    return best.agg(
        F.sum("_all").cast("bigint").alias("n_labels"), F.try_divide(F.sum("_hit").cast("double"), F.sum("_all")).alias("accuracy")
    )


def last_word_accuracy(df: DataFrame, target: str = "target", generated: str = "generated") -> DataFrame:
    """Share of texts whose generated text opens with the target word; 0 when there are none.

    A generation without any word counts as a miss.
    """
    first = F.try_element_at(words(generated), F.lit(1))
    hit = F.coalesce(first == F.col(target), F.lit(False)).cast("int")
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"),
    )


def task_pass_at_k(
    df: DataFrame, ks: Sequence[int | str] = (1,), task: str = "task_id", passed: str = "passed"
) -> DataFrame:
    """`(task, n, c, pass_at_k..)`: unbiased estimate that one of k samples passes.

    1 - C(n-c, k) / C(n, k) as a product of k factors. `"n"` stands for as many samples
    as the task has, where the estimate is whether any passed.
    """
    counts = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("c"))
    n, c = F.col("n"), F.col("c")
    for k in ks:
        if k == "n":
            value = (c > 0).cast("double")
        else:
            left = n - c
            miss = F.aggregate(
                F.sequence(F.lit(0), F.lit(int(k) - 1)),
                F.lit(1.0),
                lambda acc, j: acc * (left - j) / F.greatest(n - j, F.lit(1)),
            )
            value = F.when(c == 0, 0.0).when(left < k, 1.0).otherwise(1.0 - miss)
        counts = counts.withColumn(f"pass_at_{k}", value)
    return counts


def pass_at_k(df: DataFrame, ks: Sequence[int | str] = (1,), task: str = "task_id", passed: str = "passed") -> DataFrame:
    """Mean over tasks."""
    per_task = task_pass_at_k(df, ks, task, passed)
    return per_task.agg(
        F.count("*").alias("tasks"), *[F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks]
    )
