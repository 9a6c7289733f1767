"""Streaming tokenisation, block building and metric logging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corpusgauge.functions import text as X
from corpusgauge.operators.blocks import BATCH_ROWS, group_texts
from corpusgauge.operators.joins import measured
from corpusgauge.operators.vocabulary import tokenize
from corpusgauge.session import materialise, write_and_clear
from corpusgauge.sources.records import wide_to_long


def start(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run over what has arrived, from where the checkpoint left off."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_words(sdf: DataFrame, key: str = "row_id", col: str = "text") -> DataFrame:
    """`(key, tokens, n_tokens)`: stateless, so it appends."""
    return sdf.select(key, X.words(col).alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("bigint"))


def stream_tokenise(
    sdf: DataFrame, vocab: DataFrame, sink: str, checkpoint: str, key: str = "row_id", col: str = "text"
) -> StreamingQuery:
    """Append `(key, input_ids)` to a Parquet sink, encoding with a fitted vocabulary.

    Ids are gathered per row, which is complete within its micro-batch. The output
    folder carries the batch number, so a replayed batch replaces its own files. The
    vocabulary is measured once; what a batch derives is deleted with it.
    """
    size = measured(vocab)

    def encode(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        write_and_clear(
            spark, lambda: tokenize(materialise(batch), vocab, key, col, size=size), f"{sink}/epoch={epoch}", "overwrite"
        )

    return start(sdf.select(key, col).writeStream.foreachBatch(encode), checkpoint)


def stream_group_texts(
    sdf: DataFrame,
    block_size: int,
    sink: str,
    checkpoint: str,
    batch_rows: int = BATCH_ROWS,
    key: str = "row_id",
    ids: str = "input_ids",
) -> StreamingQuery:
    """Write fixed blocks per micro-batch; remainders drop within each group of rows.

    Rows are ordered by key inside a micro-batch. Rewriting a batch's own folder makes a
    replay after a lost executor or driver leave the same files.
    """

    def build(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        write_and_clear(
            spark, lambda: group_texts(materialise(batch), block_size, batch_rows, key, ids), f"{sink}/epoch={epoch}", "overwrite"
        )

    return start(sdf.select(key, ids).writeStream.foreachBatch(build), checkpoint)


def stream_metrics(sdf: DataFrame, sink: str, checkpoint: str, ids: tuple[str, ...] = ("run_id", "step")) -> StreamingQuery:
    """Append per-step metrics in long form while runs go on.

    A micro-batch gathers a run's rows into few files before it writes them, under its own
    number, so that a replay replaces them.
    """

    def log(batch: DataFrame, epoch: int) -> None:
        long = wide_to_long(batch, list(ids)).hint("rebalance", F.col("run_id"))
        long.write.mode("overwrite").partitionBy("run_id").parquet(f"{sink}/epoch={epoch}")

    return start(sdf.writeStream.foreachBatch(log), checkpoint)


def stream_metrics_once(
    sdf: DataFrame, sink: str, checkpoint: str, time: str = "ts", delay: str = "1 day", ids: tuple[str, ...] = ("run_id", "step")
) -> StreamingQuery:
    """`stream_metrics` in which each (run, step) is stored once, however often the run logs it.

    A run that goes on from an earlier step logs the steps in between again. The first row of a step
    stays in keyed state until the watermark is `delay` past it, and later ones are dropped; a step
    that comes back later than that, by its own `time`, is taken for a new one. The state survives
    restarts of the stream, and a replayed micro-batch writes the same folder again.
    """
    timed = sdf.withColumn(time, F.col(time).cast("timestamp"))  # a time without a zone has no watermark
    once = timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(ids))
    return stream_metrics(once.drop(time), sink, checkpoint, ids)
