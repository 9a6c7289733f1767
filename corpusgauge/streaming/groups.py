"""Fixed blocks over groups of consecutive rows that arrive in any order, over any number of micro-batches.

A stream's rows carry a dense index. The group of a row, index / rows, is the key of Spark's keyed
state: a group waits there until its last row has come, is cut into blocks and forgotten. So the
blocks depend on the rows alone, not on which files or micro-batches brought them. What is still
open when the stream ends is read from the checkpoint's state and cut like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgauge.operators.blocks import BATCH_ROWS
from corpusgauge.operators.ordering import key_bits, with_row_index
from corpusgauge.session import materialise, scratch_scope
from corpusgauge.streaming.jobs import start

BLOCKS = "batch bigint, block bigint, input_ids array<int>, labels array<int>"
STATE = "index binary, sizes binary, ids binary"  # packed numbers: row indexes, ids a row, all ids


def _pack(index: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return index.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), ids.astype("<i4").tobytes()


def _unpack(index: bytes, sizes: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(index, "<i8"), np.frombuffer(sizes, "<i4"), np.frombuffer(ids, "<i4")


def cut(batch: int, held: tuple[np.ndarray, np.ndarray, np.ndarray], block_size: int) -> pd.DataFrame:
    """A group's rows in index order, end to end, in whole blocks."""
    index, sizes, ids = held
    ends = np.cumsum(sizes)
    parts = [ids[ends[k] - sizes[k] : ends[k]] for k in np.argsort(index, kind="stable")]
    whole = np.concatenate(parts) if parts else ids
    blocks = [whole[k : k + block_size] for k in range(0, len(whole) - block_size + 1, block_size)]
    numbers = np.arange(len(blocks), dtype=np.int64)
    return pd.DataFrame({"batch": np.full(len(blocks), batch, np.int64), "block": numbers, "input_ids": blocks, "labels": blocks})


def stream_groups(
    sdf: DataFrame,
    block_size: int,
    sink: str,
    checkpoint: str,
    batch_rows: int = BATCH_ROWS,
    index: str = "row_idx",
    ids: str = "input_ids",
) -> StreamingQuery:
    """Append the blocks of every group whose rows have all come; `index` is dense from 0 and unique.

    State holds a group's rows until then: at most `batch_rows` rows for each group that is open.
    Null ids are an empty row.
    """

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        new = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in rows["ids"]]
        held = (rows["idx"].to_numpy(np.int64), np.array([len(x) for x in new], np.int32), np.concatenate(new))
        if state.exists:
            held = tuple(np.concatenate(x) for x in zip(_unpack(*state.get), held, strict=True))
        if len(held[0]) < batch_rows:
            state.update(_pack(*held))
            return
        state.remove()
        yield cut(key[0], held, block_size)

    grouped = sdf.select(F.floor(F.col(index) / batch_rows).cast("bigint").alias("grp"), F.col(index).alias("idx"), F.col(ids).alias("ids"))
    blocks = grouped.groupBy("grp").applyInPandasWithState(gather, BLOCKS, STATE, "append", GroupStateTimeout.NoTimeout)
    return start(blocks.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def open_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """`(batch, index, sizes, ids)`: groups that wait in a stopped stream's state."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.grp").alias("batch"), "value.groupState.*")


def rest(spark: SparkSession, checkpoint: str, block_size: int) -> DataFrame:
    """The blocks of groups still open when the stream ended; a group lacks rows only if they never came."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for batch, *held in zip(*(part[c] for c in ("batch", "index", "sizes", "ids")), strict=True):
                yield cut(batch, _unpack(*held), block_size)

    return open_groups(spark, checkpoint).mapInPandas(run, BLOCKS)


def number_stream(sdf: DataFrame, sink: str, checkpoint: str, key: str = "row_id", index: str = "row_idx") -> StreamingQuery:
    """Give rows a dense index in the order of arrival: by micro-batch, then by key.

    A micro-batch goes on from the rows written before it. It writes a folder with its own number,
    so a replay counts the same earlier folders and leaves the same files.
    """

    def number(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = materialise(batch)
            local = with_row_index(rows, key, "_local", key_bits(rows, key))
            local.withColumn(index, F.col("_local") + F.lit(_written(spark, sink, epoch))).drop("_local").write.mode(
                "overwrite"
            ).parquet(f"{sink}/epoch={epoch}")

    return start(sdf.writeStream.foreachBatch(number), checkpoint)


def _written(spark: SparkSession, sink: str, epoch: int) -> int:
    """Rows in the folders of earlier micro-batches."""
    if epoch == 0:
        return 0
    return spark.read.schema("epoch bigint").parquet(sink).where(F.col("epoch") < epoch).count()
