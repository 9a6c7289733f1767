"""Quantisation of float vectors and its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.operators.joins import attach_narrow
from corpusgauge.operators.ordering import KEY_BITS, running_offset
from corpusgauge.session import materialise

# The sixteen levels of the 4-bit NormalFloat code.
NF4_LEVELS = (
    -1.0,
    -0.6961928009986877,
    -0.5250730514526367,
    -0.39491748809814453,
    -0.28444138169288635,
    -0.18477343022823334,
    -0.09105003625154495,
    0.0,
    0.07958029955625534,
    0.16093020141124725,
    0.24611230194568634,
    0.33791524171829224,
    0.44070982933044434,
    0.5626170039176941,
    0.7229568362236023,
    1.0,
)
NF4_BLOCK = 64  # fixed value: elements that share one scale
SCALE_BLOCK = 256  # fixed value: scales that share one scale of their own
OUTLIER = 6.0  # fixed value: a column that reaches it is kept as it is


def absmax(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def int8_codes(v: Column, scale: Column) -> Column:
    """Codes in -127..127; a zero vector has zero codes."""
    return F.transform(v, lambda x: F.when(scale > 0, F.rint(x * 127.0 / scale)).otherwise(0.0).cast("int"))


def nf4_index(x: Column) -> Column:
    """Nearest level of a value in [-1, 1]: one more for each midpoint it passes."""
    mids = [(a + b) / 2 for a, b in zip(NF4_LEVELS, NF4_LEVELS[1:])]
    out = F.lit(0)
    for m in mids:
        out = out + (x > F.lit(m)).cast("int")
    return out


def _blocks(v: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.size(v) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * size + 1, F.lit(size)))


def quantize(df: DataFrame, col: str, bits: int = 8) -> DataFrame:
    """Add `codes`, `restored`, `mse`, `cosine` and `ratio` (quantised to 32-bit bytes).

    8 bits: one absolute-maximum scale per vector. 4 bits: NormalFloat levels with a
    scale per block of 64.
    """
    vector = F.transform(F.col(col), lambda x: x.cast("double"))
    base = df.withColumn("_v", vector)
    if bits == 8:
        scaled = base.withColumn("_s", absmax(F.col("_v"))).withColumn(
            "codes", int8_codes(F.col("_v"), F.col("_s"))
        )
        restored = F.transform("codes", lambda c: c * F.col("_s") / 127.0)
        stored = F.size("_v") + 4
    elif bits == 4:
        levels = F.array(*[F.lit(x) for x in NF4_LEVELS])
        scaled = base.withColumn("_s", F.transform(_blocks(F.col("_v"), NF4_BLOCK), absmax))
        scale = lambda i: F.element_at(F.col("_s"), F.floor(i / NF4_BLOCK).cast("int") + 1)
        scaled = scaled.withColumn(
            "codes",
            F.transform(
                "_v", lambda x, i: nf4_index(F.when(scale(i) > 0, x / scale(i)).otherwise(F.lit(0.0)))
            ),
        )
        restored = F.transform("codes", lambda c, i: F.element_at(levels, c + 1) * scale(i))
        stored = F.ceil(F.size("_v") / 2) + 4 * F.ceil(F.size("_v") / NF4_BLOCK)
    else:
        raise ValueError(f"bits must be 4 or 8, not {bits}")

    return _with_error(scaled.withColumn("restored", restored), stored).drop("_s")


def _with_error(df: DataFrame, stored: Column) -> DataFrame:
    """Add `mse`, `cosine` and `ratio` of `_v` and `restored`, which takes `stored` bytes; drop `_v`."""

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    squared = F.aggregate(
        F.zip_with("_v", "restored", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )
    norms = F.sqrt(dot("_v", "_v")) * F.sqrt(dot("restored", "restored"))
    return (
        df.withColumn("mse", F.try_divide(squared, F.size("_v")))
        .withColumn("cosine", F.try_divide(dot("_v", "restored"), norms))
        .withColumn("ratio", F.try_divide(stored.cast("double"), F.size("_v") * 4))
        .drop("_v")
    )


def outlier_columns(df: DataFrame, col: str, threshold: float = OUTLIER) -> DataFrame:
    """`(column, top)`: places at which some vector's magnitude reaches the threshold, counted from 0.

    Maxima are combined in each task, so a column is one row a task, whatever the number of vectors.
    """
    tops = df.select(F.posexplode(col).alias("column", "x")).groupBy("column").agg(F.max(F.abs(F.col("x").cast("double"))).alias("top"))
    return tops.where(F.col("top") >= threshold)


def quantize_outliers(df: DataFrame, col: str, threshold: float = OUTLIER) -> DataFrame:
    """8 bits with outlier columns kept: a few columns of all vectors hold the large values.

    A column in which any vector reaches the threshold stays in 32 bits in every vector; the rest of
    a vector has one absolute-maximum scale, which the large values no longer stretch. Adds `codes`
    (null in a kept column), `kept` (the kept columns' values in order), `outlier_share`, `restored`,
    `mse`, `cosine` and `ratio`. The columns are measured first, in a pass over the vectors, and
    reach the second pass as one list, no longer than a vector.
    """
    listed = materialise(outlier_columns(df, col, threshold).agg(F.array_sort(F.collect_list("column")).alias("columns")))
    base = df.withColumn("_v", F.transform(F.col(col), lambda x: x.cast("double"))).withColumn("_o", listed.scalar())
    at = F.filter("_o", lambda k: k < F.size("_v"))  # vectors may differ in length
    # A flag per place, so that a place is not looked up in the list.
    flags = F.aggregate(
        at, F.transform("_v", lambda x: F.lit(False)),
        lambda acc, k: F.concat(F.slice(acc, F.lit(1), k), F.array(F.lit(True)), F.slice(acc, k + 2, F.size(acc))),
    )
    flagged = base.withColumn("_f", flags)
    rest = F.zip_with("_v", "_f", lambda x, f: F.when(~f, x))
    scaled = flagged.withColumn("_s", F.array_max(F.transform(rest, F.abs)))
    s = F.col("_s")
    coded = scaled.withColumn(
        "codes", F.transform(rest, lambda x: F.when(x.isNotNull(), F.when(s > 0, F.rint(x * 127.0 / s)).otherwise(0.0).cast("int")))
    ).withColumn("kept", F.transform(at, lambda k: F.get("_v", k).cast("float")))
    restored = F.zip_with("codes", "_v", lambda c, x: F.coalesce(c * s / 127.0, x))
    stored = F.size("_v") - F.size("kept") + 4 * F.size("kept") + 4
    measured = coded.withColumn("outlier_share", F.try_divide(F.size("kept").cast("double"), F.size("_v")))
    return _with_error(measured.withColumn("restored", restored), stored).drop("_o", "_f", "_s")


def scale_blocks(scales: DataFrame, key: str, bits: int = KEY_BITS, size: int = SCALE_BLOCK) -> DataFrame:
    """Quantise scales again: `(key, _scales, codes2)` from `(key, _scales)`, arrays of one scale a block.

    Scales are taken in key order, row after row, and every `size` of them share an absolute maximum
    once their overall mean is taken off; so a block of scales crosses rows. Only the rows' numbers of
    scales are ordered and added up. `codes2` holds 8-bit codes, `_restored` the scales they stand for.
    """
    stored = materialise(scales)
    mean = stored.select(F.explode("_scales").alias("s")).agg(F.avg("s").alias("mean"))
    placed = running_offset(stored, key, F.size("_scales"), "_at", bits).withColumn("_mean", mean.scalar())
    each = placed.select(key, "_mean", "_at", F.posexplode("_scales").alias("k", "s")).withColumn("s", F.col("s") - F.col("_mean"))
    top = F.max(F.abs("s")).over(Window.partitionBy(F.floor((F.col("_at") + F.col("k")) / size)))  # at most `size` rows
    coded = each.withColumn("top", top).withColumn(
        "code", F.when(F.col("top") > 0, F.rint(F.col("s") * 127.0 / F.col("top"))).otherwise(0.0).cast("int")
    )
    own = F.struct("k", "code", (F.col("code") * F.col("top") / 127.0 + F.col("_mean")).alias("s"))
    rows = coded.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("_p"))  # a vector's own scales
    return rows.select(key, F.col("_p.code").alias("codes2"), F.col("_p.s").alias("_restored"))


def quantize_twice(df: DataFrame, key: str, col: str, bits: int = KEY_BITS) -> DataFrame:
    """4-bit NormalFloat with its scales in 8 bits: adds what `quantize` adds, and `codes2`.

    `key` is a unique integer that orders the vectors. An empty vector has no scale and null measures.
    """
    base = df.withColumn("_v", F.transform(F.col(col), lambda x: x.cast("double")))
    size = F.size("_v")
    scales = F.when(size > 0, F.transform(_blocks(F.col("_v"), NF4_BLOCK), absmax)).otherwise(F.array().cast("array<double>"))
    base = materialise(base.withColumn("_s", scales))
    twice = materialise(scale_blocks(base.where(F.size("_s") > 0).select(key, F.col("_s").alias("_scales")), key, bits))
    rows = twice.count()
    full = attach_narrow(base.where(F.size("_s") > 0), twice, key, rows).unionByName(
        base.where(F.coalesce(F.size("_s"), F.lit(0)) <= 0).withColumn("codes2", F.array().cast("array<int>")).withColumn(
            "_restored", F.array().cast("array<double>")
        )
    )
    levels = F.array(*[F.lit(x) for x in NF4_LEVELS])

    def scale(name: str, i: Column) -> Column:
        return F.get(name, F.floor(i / NF4_BLOCK).cast("int"))

    coded = full.withColumn("codes", F.transform(
        "_v", lambda x, i: nf4_index(F.when(scale("_s", i) > 0, x / scale("_s", i)).otherwise(F.lit(0.0)))
    ))
    restored = F.transform("codes", lambda c, i: F.element_at(levels, c + 1) * scale("_restored", i))
    # A block has half a byte an element, a byte for its scale, and its part of a 32-bit scale of scales.
    stored = F.ceil(size / 2) + F.size("codes2") * (1 + 4.0 / SCALE_BLOCK)
    return _with_error(coded.withColumn("restored", restored), stored).drop("_s", "_restored")
