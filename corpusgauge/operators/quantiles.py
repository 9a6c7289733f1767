"""Exact grouped percentiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.operators.joins import lookup
from corpusgauge.session import materialise, setting

ACCURACY = 10_000  # values a task may gather for one percentile; `spark.corpusgauge.accuracy` changes it
GRID = 100  # steps of a sketch; a round narrows a bracket to about four of them


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, marks: Mapping[str, float]
) -> DataFrame:
    """`(by.., mark..)`: linearly interpolated percentiles of the non-null values.

    A null key is a group; a group without values is not returned. Groups of up to ACCURACY
    values are small enough for the built-in aggregate, which holds a group's values. Larger
    ones are first narrowed to a bracket of values.
    """
    limit = int(setting(df.sparkSession, "accuracy", ACCURACY))
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # As a struct, a null key compares equal to itself.
    rows = rows.select(F.struct(*keys).alias("_g"), "_v")
    sizes = materialise(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    biggest = sizes.agg(F.max("_n")).first()[0] or 0
    if biggest <= limit:
        out = _small_groups(rows, marks)
    else:
        # Stored, since every round below reads the values again.
        tagged = materialise(lookup(rows, sizes.select("_g", "_n", F.col("_n").alias("n")), ["_g"], "_n", ["_v"], stored=True))
        small = _small_groups(tagged.where(F.col("n") <= limit), marks)
        large = _large_groups(tagged.where(F.col("n") > limit).select("_g", "_v"), sizes.where(F.col("_n") > limit), marks, limit)
        out = small.unionByName(large)
    out = out.select(*[F.col("_g")[k].alias(k) for k in keys], *marks)
    return out if by else out.drop("_all")


def _small_groups(rows: DataFrame, marks: Mapping[str, float]) -> DataFrame:
    return rows.groupBy("_g").agg(*[F.percentile("_v", float(q)).alias(name) for name, q in marks.items()])


def _large_groups(rows: DataFrame, sizes: DataFrame, marks: Mapping[str, float], limit: int) -> DataFrame:
    """Percentiles of big groups, none of which is gathered.

    A bracket of values starts as the whole group. Each round counts, combined map-side, the
    values below it, inside it and on its two edges, and sketches the inside at GRID steps. Ranks
    on or next to an edge are known then. Otherwise the bracket becomes the steps two away from the
    wanted ranks, and its edges move inwards at least to the next values, so every round gets
    nearer; as a rule it narrows a bracket some 25 times. A sketch that misses its rank, which the
    counts show, makes the bracket wide again. A bracket of few values is read off.
    """
    wanted = [
        F.struct(F.lit(name).alias("mark"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at"))
        for name, q in marks.items()
    ]
    state = materialise(sizes.select("_g", "_n", "lo", "hi", F.inline(F.array(*wanted)), F.lit(0).alias("missed")))
    widest = sizes.select("_g", F.col("lo").alias("least"), F.col("hi").alias("most"))
    part = F.col("at") - F.floor("at")
    found = None
    while True:
        measured = _measure(rows, state).withColumns(
            {"first": F.floor("at") - F.col("below"), "last": F.ceil("at") - F.col("below")}
        )
        measured = measured.withColumns({"v0": _known("first"), "v1": _known("last")})
        holds = (F.col("first") >= 0) & (F.col("last") < F.col("inside"))
        measured = materialise(measured.withColumn("holds", holds))
        settled = F.col("holds") & F.col("v0").isNotNull() & F.col("v1").isNotNull()
        few = F.col("holds") & ~settled & (F.col("inside") <= limit)
        known = measured.where(settled).select("_g", "mark", ((1 - part) * F.col("v0") + part * F.col("v1")).alias("value"))
        answered = materialise(known.unionByName(_read_off(rows, measured.where(few), part)))
        found = answered if found is None else found.unionByName(answered)
        rest = measured.where(~settled & ~few)
        if rest.limit(1).count() == 0:
            return found.groupBy("_g").pivot("mark", list(marks)).agg(F.first("value"))

        def step(rank: str, away: int) -> Column:
            spot = F.rint(F.col(rank) * GRID / F.greatest(F.col("inside") - 1, F.lit(1))) + F.lit(away) * (1 + F.col("missed"))
            return F.get("grid", F.least(F.greatest(spot, F.lit(0)), F.lit(GRID)).cast("int"))

        low = F.greatest(step("first", -2), F.when(F.col("first") >= F.col("n_lo"), F.col("in_lo")).otherwise(F.col("lo")))
        high = F.least(step("last", 2), F.when(F.col("last") < F.col("inside") - F.col("n_hi"), F.col("in_hi")).otherwise(F.col("hi")))
        state = materialise(rest.join(widest, "_g").select(
            "_g", "_n", "mark", "at",
            F.when(F.col("holds"), low).otherwise(F.col("least")).alias("lo"),
            F.when(F.col("holds"), high).otherwise(F.col("most")).alias("hi"),
            F.when(F.col("holds"), F.col("missed")).otherwise(F.col("missed") * 2 + 1).alias("missed"),
        ))


def _known(rank: str) -> Column:
    """The value of a rank inside a bracket, if it is on an edge or the next value to one."""
    r, upper = F.col(rank), F.col("inside") - F.col("n_hi")
    return (
        F.when((r < 0) | (r >= F.col("inside")), F.lit(None).cast("double"))
        .when(r < F.col("n_lo"), F.col("lo")).when(r >= upper, F.col("hi"))
        .when(r == F.col("n_lo"), F.col("in_lo")).when(r == upper - 1, F.col("in_hi"))
    )


def _marked(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with each bracket of their group; a group's brackets are one per mark."""
    brackets = state.groupBy("_g").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("mark", "lo", "hi")).alias("_b"))
    joined = lookup(rows, brackets, ["_g"], "_n", ["_v"])
    return joined.where(F.col("_b").isNotNull()).select("_g", "_v", F.inline("_b"))


def _measure(rows: DataFrame, state: DataFrame) -> DataFrame:
    """`state` with the values below, inside and on the edges of each bracket, and the inside's sketch."""
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    between = (v > lo) & (v < hi)
    points = [k / GRID for k in range(GRID + 1)]
    counted = _marked(rows, state).groupBy("_g", "mark").agg(
        F.count_if(v < lo).alias("below"),
        F.count_if(v.between(lo, hi)).alias("inside"),
        F.count_if(v == lo).alias("n_lo"),
        F.count_if(v == hi).alias("n_hi"),
        F.min(F.when(between, v)).alias("in_lo"),
        F.max(F.when(between, v)).alias("in_hi"),
        F.percentile_approx(F.when(v.between(lo, hi), v), points, 100 * GRID).alias("grid"),
    )
    return state.join(counted, ["_g", "mark"])


def _read_off(rows: DataFrame, measured: DataFrame, part: Column) -> DataFrame:
    """`(_g, mark, value)` of brackets that hold few values."""
    held = _marked(rows, measured.select("_g", "_n", "mark", "lo", "hi")).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    values = held.groupBy("_g", "mark").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    value = (1 - part) * F.get("_s", F.col("first").cast("int")) + part * F.get("_s", F.col("last").cast("int"))
    return measured.select("_g", "mark", "at", "first", "last").join(values, ["_g", "mark"]).select("_g", "mark", value.alias("value"))
