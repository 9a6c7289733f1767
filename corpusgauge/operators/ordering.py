"""Row order, dense indexes and running offsets without a one-task window.

A corpus is ordered by a unique integer key. Keys are cut into buckets by their high
bits, buckets into larger buckets, and so on, so each window partition holds at most
2**bits distinct values of the level below, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.text import as_column
from corpusgauge.operators.joins import null_safe_join
from corpusgauge.session import materialise

ROW_BITS = 12  # a bucket holds at most 4096 rows, which may carry whole token arrays
TOTAL_BITS = 17  # upper levels hold one narrow total per bucket
KEY_BITS = 63


def key_range(df: DataFrame, key: str) -> tuple[int | None, int | None]:
    """Smallest and greatest key: one scan of the key column."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    return low, high


def range_bits(low: int | None, high: int | None) -> int:
    """Bits that keys from low to high take; spares levels that would be empty."""
    if low is None or low < 0:
        return KEY_BITS
    return max(int(high).bit_length(), 1)


def key_bits(df: DataFrame, key: str) -> int:
    return range_bits(*key_range(df, key))


def _bucket_starts(totals: DataFrame, bits: int) -> DataFrame:
    """Sum of `_t` over all lower buckets `_b`, which span `bits` bits."""
    if bits <= TOTAL_BITS + 1:
        # At most 2**18 totals remain, whatever the size of the corpus.
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    parts = totals.withColumn("_p", F.shiftright("_b", TOTAL_BITS))
    upper = parts.groupBy(F.col("_p").alias("_b")).agg(F.sum("_t").alias("_t"))
    starts = _bucket_starts(upper, bits - TOTAL_BITS).select(
        F.col("_b").alias("_p"), F.col("_start").alias("_upper")
    )
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_local", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return local.join(starts, "_p").select("_b", (F.col("_upper") + F.col("_local")).alias("_start"))


def running_offset(
    df: DataFrame, key: str, size: Column | str, name: str = "offset", bits: int = KEY_BITS
) -> DataFrame:
    """Add the sum of `size` over all rows with a smaller key."""
    # Working columns stay clear of the caller's: _b, _size, _before, _start.
    sized = df.withColumn("_b", F.shiftright(F.col(key).cast("bigint"), ROW_BITS)).withColumn(
        "_size", as_column(size).cast("bigint")
    )
    totals = sized.groupBy("_b").agg(F.sum("_size").alias("_t"))
    starts = _bucket_starts(totals, max(bits - ROW_BITS, 1))
    before = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return (
        local.join(starts, "_b")
        .withColumn(name, F.col("_start") + F.col("_before"))
        .drop("_b", "_size", "_before", "_start")
    )


def _bucket_lasts(lasts: DataFrame, bits: int) -> DataFrame:
    """The nearest non-null `_l` of a lower bucket `_b`; buckets span `bits` bits."""
    nearest = F.last("_l", ignorenulls=True)
    if bits <= TOTAL_BITS + 1:
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return lasts.select("_b", nearest.over(before).alias("_low"))
    parts = lasts.withColumn("_p", F.shiftright("_b", TOTAL_BITS))
    known = F.max_by("_l", F.when(F.col("_l").isNotNull(), F.col("_b")))
    upper = _bucket_lasts(parts.groupBy(F.col("_p").alias("_b")).agg(known.alias("_l")), bits - TOTAL_BITS)
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_near", nearest.over(before))
    joined = local.join(upper.select(F.col("_b").alias("_p"), F.col("_low").alias("_far")), "_p")
    return joined.select("_b", F.coalesce("_near", "_far").alias("_low"))


def last_before(df: DataFrame, key: str, value: str, name: str, bits: int = KEY_BITS) -> DataFrame:
    """Add the nearest non-null `value` of a row with a smaller key; null if there is none.

    Buckets as for `running_offset`, so a long stretch of nulls is no long window.
    """
    placed = df.withColumn("_b", F.shiftright(F.col(key).cast("bigint"), ROW_BITS))
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key)))
    lows = _bucket_lasts(placed.groupBy("_b").agg(known.alias("_l")), max(bits - ROW_BITS, 1))
    before = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_near", F.last(value, ignorenulls=True).over(before))
    return near.join(lows, "_b").withColumn(name, F.coalesce("_near", "_low")).drop("_b", "_near", "_low")


def with_row_index(df: DataFrame, key: str, name: str = "row_idx", bits: int = KEY_BITS) -> DataFrame:
    """Number the rows 0, 1, 2.. in key order."""
    return running_offset(df, key, F.lit(1), name, bits)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows 0, 1, 2.. in any sort order.

    The sort is range-partitioned over the executors and written out once, because a
    second run could sample other range bounds; the starts table has one row per
    partition.
    """
    seq = materialise(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftright("_seq", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        seq.groupBy(part)
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        seq.withColumn("_part", F.shiftright("_seq", 33))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_seq", "_start")
    )


def sort_by_length(df: DataFrame, size: Column | str, key: str = "row_id") -> DataFrame:
    """Shortest first; equal lengths keep their key order."""
    return df.orderBy(as_column(size), key)


GATHERED = 100_000  # rows that one task may sort for a first-N selection


def limit_n(df: DataFrame, n: int | None, key: str = "row_id") -> DataFrame:
    """First n rows in key order; none or n <= 0 keeps all. Keys are unique.

    Few rows are gathered by one task. For more, only the keys are numbered, and the rows
    below the boundary key are filtered where they lie.
    """
    if n is None or n <= 0:
        return df
    if n <= GATHERED:
        return df.orderBy(key).limit(n)
    end = with_row_index(df.select(key), key, "_idx", key_bits(df, key)).where(F.col("_idx") == n).first()
    return df if end is None else df.where(F.col(key) < F.lit(end[key])).orderBy(key)


def take_first(
    df: DataFrame,
    n: int | None,
    order: str = "filter_then_select",
    predicate: Column | None = None,
    key: str = "row_id",
) -> DataFrame:
    """Positional selection of n rows in key order, before or after a predicate.

    select_then_filter: the first n rows, then those that pass (fewer than n may stay).
    filter_then_select: the first n rows that pass; none or n <= 0 keeps all of them.
    early_stop: as filter_then_select, for a scan that ends after n hits.
    """
    passing = predicate if predicate is not None else F.lit(True)
    if order == "select_then_filter":
        return limit_n(df, n, key).where(passing)
    if order == "filter_then_select":
        if n is None or n <= 0:
            return df.where(passing)
        return limit_n(_first_hits(df, n, passing, key).where(passing), n, key)
    if order == "early_stop":
        # The count is checked after each row, so a count below 1 still looks at one row.
        if n is None or n <= 0:
            return limit_n(df, 1, key).where(passing)
        return limit_n(_first_hits(df, n, passing, key).where(passing), n, key)
    raise ValueError(f"unknown selection order {order!r}")


def _first_hits(df: DataFrame, n: int, passing: Column, key: str) -> DataFrame:
    """Rows up to a key below which n rows are sure to pass; all rows if there is none.

    A costly predicate then runs over the start of the corpus only. The range grows
    eightfold until it holds enough hits, and the key bound is pushed to the scan.
    """
    total, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    if not total:
        return df
    span = high - low + 1
    width = max(span * 8 * n // total, 1)
    while width < span:
        start = df.where(F.col(key) < F.lit(low + width))
        if start.where(passing).limit(n).count() >= n:
            return start
        width *= 8
    return df


def stride_windows(n: Column | str, stride: int, context: int) -> Column:
    """Array of right-extending windows (window, begin, end, prev_end) over positions 0..n-1."""
    total = as_column(n)

    def window(w: Column) -> Column:
        before = F.when(w > 0, F.least((w - 1) * stride + context, total)).otherwise(F.lit(0))
        return F.struct(
            w.cast("bigint").alias("window"),
            (w * stride).cast("bigint").alias("begin"),
            F.least(w * stride + context, total).cast("bigint").alias("end"),
            before.cast("bigint").alias("prev_end"),
        )

    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(total / stride) - 1, F.lit(0))), window)


def prev_end(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add the previous window's end, 0 for the first, to any table of numbered windows.

    Windows stand at equal steps, so the end is looked up by window number with an
    equi-join rather than a lag over one long partition.
    """
    by = by or []
    before = df.select(*by, (F.col("window") + 1).alias("window"), F.col("end").alias("prev_end"))
    return df.join(before, [*by, "window"], "left").withColumn("prev_end", F.coalesce("prev_end", F.lit(0)))


def share_of_total(df: DataFrame, value: str, by: list[str] | None = None, name: str = "time_pct") -> DataFrame:
    """Add each row's percentage of the total of its group (or of everything); nulls are a group."""
    if by:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
        joined = null_safe_join(df, totals, by)
    else:
        joined = df.withColumn("_total", df.agg(F.sum(value)).scalar())
    return joined.withColumn(name, F.try_divide(F.lit(100.0) * F.col(value), F.col("_total"))).drop("_total")
