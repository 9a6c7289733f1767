"""Fixed-size token blocks, batches, splits and shifted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions import arrays as A
from corpusgauge.operators.joins import attach_narrow
from corpusgauge.operators.ordering import KEY_BITS, key_bits, running_offset, with_row_index
from corpusgauge.session import materialise

BATCH_ROWS = 1000  # fixed value: rows concatenated together before chunking


def group_texts(
    df: DataFrame,
    block_size: int,
    batch_rows: int = BATCH_ROWS,
    key: str = "row_id",
    ids: str = "input_ids",
    bits: int = KEY_BITS,
    parallel: Sequence[str] = (),
) -> DataFrame:
    """`(batch, block, input_ids, parallel.., labels)`: each batch's ids laid end to end and cut.

    `parallel` names arrays as long as the ids, such as `attention_mask`, that are cut alike.

    A batch is `batch_rows` rows in key order; its last partial block is dropped. Only
    sizes are ordered and numbered. Rows are cut into pieces at block edges, so whole
    arrays travel once and a block gathers at most `block_size` pieces.
    """
    sizes = materialise(df.select(key, F.size(ids).cast("bigint").alias("_len")))
    indexed = with_row_index(sizes, key, "_idx", bits)
    batched = indexed.select(F.floor(F.col("_idx") / batch_rows).cast("bigint").alias("batch"), key, "_len")
    before = Window.partitionBy("batch").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = batched.withColumn("_off", F.coalesce(F.sum("_len").over(before), F.lit(0))).where(F.col("_len") > 0)
    placed = attach_narrow(df.select(key, ids, *parallel), offsets, key, sizes.count())

    arrays = [ids, *parallel]

    def piece(b):
        start = F.greatest(b * block_size - F.col("_off"), F.lit(0))
        stop = F.least((b + 1) * block_size - F.col("_off"), F.col("_len"))
        return F.struct(
            b.alias("block"),
            (F.col("_off") + start).alias("at"),
            *[F.slice(c, (start + 1).cast("int"), (stop - start).cast("int")).alias(f"piece{k}") for k, c in enumerate(arrays)],
        )

    first = F.floor(F.col("_off") / block_size)
    last = F.floor((F.col("_off") + F.col("_len") - 1) / block_size)
    pieces = placed.select("batch", F.inline(F.transform(F.sequence(first, last), piece)))
    return (
        pieces.groupBy("batch", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", *[f"piece{k}" for k in range(len(arrays))]))).alias("_p"))
        .select("batch", "block", *[F.flatten(F.col(f"_p.piece{k}")).alias(c) for k, c in enumerate(["input_ids", *parallel])])
        .where(F.size("input_ids") == block_size)
        .withColumn("labels", F.col("input_ids"))
    )


def first_blocks(blocks: DataFrame, n: int | None) -> DataFrame:
    """The first n blocks in (batch, block) order; none or n <= 0 keeps all.

    Blocks are counted per batch, so only batches up to the nth block are kept, and of the
    last one its first blocks; a batch numbers its blocks from 0 without gaps.
    """
    if n is None or n <= 0:
        return blocks
    sizes = materialise(blocks.groupBy("batch").agg(F.count("*").alias("_n")))
    starts = running_offset(sizes, "batch", "_n", "_ahead", key_bits(sizes, "batch")).where(F.col("_ahead") < n)
    return blocks.join(starts.select("batch", "_ahead"), "batch").where(F.col("_ahead") + F.col("block") < n).drop("_ahead")


def pad(df: DataFrame, length: int, pad_id: int, ids: str = "input_ids") -> DataFrame:
    """Pad ids on the right to a length, with the mask that tells real ids from padding."""
    return df.withColumn("attention_mask", A.attention_mask(ids, length)).withColumn(
        ids, A.pad_ids(ids, length, pad_id)
    )


def batch_id(df: DataFrame, size: int = 8, key: str = "row_id", bits: int = KEY_BITS) -> DataFrame:
    """Number fixed-size batches of rows in key order; the last may be partial."""
    return with_row_index(df, key, "_idx", bits).withColumn(
        "batch", F.floor(F.col("_idx") / size).cast("bigint")
    ).drop("_idx")


def shift_labels(df: DataFrame, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """One `(pos, token, label)` row per position that has a next label in its array."""
    keep = [c for c in df.columns if c not in (ids, labels)]
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    pairs = F.arrays_zip(
        F.slice(ids, F.lit(1), n).alias("token"), F.slice(labels, F.lit(2), n).alias("label")
    )
    return df.select(*keep, F.posexplode(pairs).alias("pos", "_p")).select(
        *keep, "pos", F.col("_p")["token"].alias("token"), F.col("_p")["label"].alias("label")
    )


def split_point(n, pct: float):
    """Rows before the cut of a percentage split: nearest, halves to even."""
    return F.rint(n * pct / 100.0).cast("bigint")


def _validation_end(df: DataFrame, pct: float, key: str, bits: int) -> int | None:
    """Key of the first training row; None when every row validates."""
    cut = df.agg(split_point(F.count("*"), pct)).first()[0]
    found = with_row_index(df.select(key), key, "_idx", bits).where(F.col("_idx") == cut).first()
    return found[key] if found else None


def split_validation(
    df: DataFrame, pct: float = 5, key: str = "row_id", bits: int = KEY_BITS, existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the first pct% of rows validate, only if no validation set exists.

    Only the keys are numbered. The boundary key then splits the rows where they lie,
    as a filter pushed to the scan.
    """
    if existing is not None:
        return df, existing
    end = _validation_end(df, pct, key, bits)
    if end is None:
        return df.limit(0), df
    return df.where(F.col(key) >= F.lit(end)), df.where(F.col(key) < F.lit(end))


def mark_split(df: DataFrame, pct: float = 5, key: str = "row_id", bits: int = KEY_BITS) -> DataFrame:
    """The same split as a column, for a write partitioned by it."""
    end = _validation_end(df, pct, key, bits)
    inside = F.lit(True) if end is None else F.col(key) < F.lit(end)
    return df.withColumn("split", F.when(inside, "validation").otherwise("train"))
