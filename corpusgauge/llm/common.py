"""What several of the operators share: batches, words, stable keys, derived tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 2 << 20  # text handed to a Python task at a time
BATCH_ROWS = 4096


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small whatever the length of the texts.

    A batch ends at the first row beyond the byte bound, so one holds at most that plus one text.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def frees(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back when a task ends.

    Spark keeps Python workers for later tasks, idle ones beside the new, so what their
    allocators hold on to would add up.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab to carriage return: what `bytes.split` yields."""
    return text.split()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def blocks(rows: Iterator, size: int) -> Iterator[list]:
    """Rows in lists of at most `size`."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64; its constants are fixed)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def crc_remainder(column: str, divisor: int):
    """crc32 of the id written as text, modulo `divisor`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The frame's schema with more columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to those given that the frame does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
