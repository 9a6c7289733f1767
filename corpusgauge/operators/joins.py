"""Joins that stay balanced on hot keys, and the small pairing joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.session import materialise, setting

# Bounds; `spark.corpusgauge.smallRows`, `smallBytes`, `hashRows` and `hotKeys` change them.
HOT_KEYS = 1000  # least bound on the rows broadcast for hot keys
HOT_SLICES = 1 << 16
SMALL_ROWS = 1_000_000  # a lookup table this short and this light is broadcast whole
SMALL_BYTES = 32 << 20
HASH_ROWS = 1_000_000  # lookup rows a task may hold in memory
SERVED_SHARE = 0.6  # rows the broadcast must serve to make a second read of the left worth it


def small_rows(spark: SparkSession) -> float:
    return setting(spark, "smallRows", SMALL_ROWS)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(spark: SparkSession) -> float:
    """A key is hot above 1 / this of all rows: a tenth of an average task's share, with many tasks."""
    least = setting(spark, "hotKeys", HOT_KEYS)
    return max(least, min(least * shuffle_tasks(spark) / 100, small_rows(spark)))


def may_hash(spark: SparkSession, rows: float) -> bool:
    """Whether a task's part of a shuffled table of so many evenly dealt rows fits in its memory."""
    return rows / shuffle_tasks(spark) <= setting(spark, "hashRows", HASH_ROWS)


def is_small(spark: SparkSession, rows: int, size: int) -> bool:
    """Whether a table of so many rows and bytes may be broadcast."""
    return rows <= small_rows(spark) and size <= setting(spark, "smallBytes", SMALL_BYTES)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys come from the left."""
    theirs = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(theirs)
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(theirs[k]))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*theirs.values())


def row_bytes(df: DataFrame) -> Column:
    """Rough bytes of a row: strings by length, numbers flat, nested values as text."""
    total = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.StringType):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.octet_length(F.to_json(F.struct(field.name)))
        total = total + F.lit(16)
    return total


def measured(df: DataFrame, weight: str | None = None) -> tuple[int, int, bool]:
    """Rows, total weight and whether the table is small enough to broadcast, by counting."""
    weights = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.lit(0)
    rows, total = df.agg(F.count("*"), weights).first()
    if rows > small_rows(df.sparkSession):
        return rows, total, False
    size = df.agg(F.sum(row_bytes(df))).first()[0]
    return rows, total, is_small(df.sparkSession, rows, size or 0)


def heaviest(table: DataFrame, weight: str, total: int) -> tuple[int, float]:
    """Least weight of the keys to broadcast, and the share of rows they own.

    As many of the heaviest keys as fit the broadcast bounds, and in any case the hot ones, of
    which there are fewer than `hot_keys`. The window is over distinct weights: w of them take at
    least w * w / 2 rows, so 10^12 rows have at most 1.5 million.
    """
    spark = table.sparkSession
    steps = table.groupBy(F.col(weight).alias("w")).agg(
        F.count("*").alias("rows"), F.sum(row_bytes(table)).alias("bytes")
    )
    heavier = Window.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("w", (F.col("w") * F.col("rows")).alias("owned"), *[
        F.sum(c).over(heavier).alias(c) for c in ("rows", "bytes")
    ])
    fits = (F.col("rows") <= small_rows(spark)) & (F.col("bytes") <= setting(spark, "smallBytes", SMALL_BYTES))
    chosen = steps.where(fits | (F.col("w") * hot_keys(spark) > F.lit(total)))
    least, owned = chosen.agg(F.min("w"), F.sum("owned")).first()
    return (total + 1, 0.0) if least is None else (least, owned / max(total, 1))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    weight: str | None,
    salt: list[str],
    stored: bool = False,
    size: tuple[int, int, bool] | None = None,
) -> DataFrame:
    """Left-join a table unique on `keys` where some keys may own a third of `left`.

    `weight` is the number of left rows per key; if None, a large table is first met with
    the keys counted in `left`, those it lacks included. The table is written out first
    unless `stored`, then measured, unless its `size` is known.

    A small table is broadcast. Of a large one the heaviest keys are broadcast, and the
    others are too light to skew a shuffle. If the heaviest own most rows, the rows they
    serve are not shuffled at all, at the price of reading `left` twice. Otherwise `left`
    is read once, and rows already served or without a key are spread by `salt`.
    """
    payload = [c for c in right.columns if c not in keys and c != weight]
    table = right if stored else materialise(right)
    rows, total, small = size or measured(table, weight)
    if small:
        return left.join(F.broadcast(table.select(*keys, *payload)), keys, "left").select(*left.columns, *payload)
    if weight is None:
        weight = "_rows"
        table = materialise(key_weights(left, keys, weight).join(table, keys, "left"))
        rows, total, _ = measured(table, weight)
    least, share = heaviest(table, weight, total)
    twice = share >= SERVED_SHARE
    is_hot = F.col(weight) >= F.lit(least) if twice else F.col(weight) * hot_keys(left.sparkSession) > F.lit(total)
    hot = table.where(is_hot).select(*keys, F.struct(*payload).alias("_hot"))
    cold = table.where(~is_hot).select(*keys, F.struct(*payload).alias("_cold"))
    # Unique keys hash evenly, so a task's part of the table is known; within bounds it is
    # hashed in memory, which spares sorting the many left rows.
    cold = cold.hint("shuffle_hash" if may_hash(left.sparkSession, rows) else "merge")
    settled = F.col("_hot").isNotNull()
    for k in keys:
        settled = settled | F.col(k).isNull()
    served = left.join(F.broadcast(hot), keys, "left")
    if twice:
        done = served.where(settled).select(*left.columns, *[F.col("_hot")[c].alias(c) for c in payload])
        rest = served.where(~settled).select(*left.columns).join(cold, keys, "left")
        return done.union(rest.select(*left.columns, *[F.col("_cold")[c].alias(c) for c in payload]))
    spread = F.pmod(F.xxhash64(*salt), F.lit(HOT_SLICES)).cast("int") + 1
    sliced = served.withColumn("_slice", F.when(settled, spread).otherwise(F.lit(0)))
    joined = sliced.join(cold.withColumn("_slice", F.lit(0)), [*keys, "_slice"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[found[c].alias(c) for c in payload])


def key_weights(left: DataFrame, keys: list[str], name: str = "_rows") -> DataFrame:
    """Rows per key, combined map-side."""
    return left.groupBy(*keys).agg(F.count("*").alias(name))


def attach_narrow(wide: DataFrame, narrow: DataFrame, key: str, rows: int) -> DataFrame:
    """Join a few fixed-width columns per key onto wide rows, on a key unique in both.

    A narrow side of known, small row count is broadcast, so the wide rows stay put.
    Otherwise both are shuffled by the key, and the narrow side is hashed if a task's part
    of it fits in memory, else both are sorted. Left alone, the planner may take arrays for
    small and broadcast the wide side.
    """
    spark = wide.sparkSession
    if rows <= small_rows(spark):
        return wide.join(F.broadcast(narrow), key)
    return wide.join(narrow.hint("shuffle_hash" if may_hash(spark, rows) else "merge"), key)


def expand_samples(df: DataFrame, n: int) -> DataFrame:
    """Each task n times, numbered 0..n-1."""
    return df.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(
        "sample_id", F.lit(0)
    ).limit(0)


def attach_problems(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """Completions with their problem's columns; completions of no known task drop out.

    Problems are unique by task; adaptive execution broadcasts them when their measured
    size allows and splits a skewed task otherwise.
    """
    return completions.join(problems, "task_id")


def missing_problems(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """Tasks that have completions but no problem record."""
    tasks = completions.groupBy("task_id").agg(F.count("*").alias("n_completions"))
    return tasks.join(problems.select("task_id"), "task_id", "left_anti")


def reindex(df: DataFrame, key: str, order: list[str], position: str = "ord") -> DataFrame:
    """Rows in an explicit category order; a category with no row is an error."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} string, {position} int")
    # The dimension is the literal list given, so broadcasting it is bounded by the call.
    present = df.select(key, F.lit(True).alias("_present")).distinct()
    checked = dim.join(present, key, "left").select(
        key,
        F.when(F.col("_present"), F.col(position))
        .otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key))).cast("int"))
        .alias(position),
    )
    return df.join(F.broadcast(checked), key).orderBy(position)


def diff_profiles(a: DataFrame, b: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two profiler tables side by side by (report, name), with the change in total.

    A name that one report lacks took no time and no calls there.
    """
    left, right = suffixes

    def side(df: DataFrame, tail: str) -> DataFrame:
        return df.select("report", "name", F.col("total").alias(f"total{tail}"), F.col("n").alias(f"n{tail}"))

    numbers = [f"total{left}", f"n{left}", f"total{right}", f"n{right}"]
    both = side(a, left).join(side(b, right), ["report", "name"], "full_outer").fillna(0, numbers)
    return both.withColumn("total_change", F.col(f"total{right}") - F.col(f"total{left}"))
