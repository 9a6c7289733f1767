"""Session settings, the shared work folder and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark options the jobs rely on; a cluster may set its own partition counts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "16g", app: str = "corpusgauge") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and derived tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a temporary folder: on a cluster, files there die with their machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corpusgauge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def setting(spark: SparkSession, name: str, default: float) -> float:
    """A bound that `spark.corpusgauge.<name>` may change; see `operators.joins` for what they are."""
    return float(spark.conf.get(f"spark.corpusgauge.{name}", str(default)))


_scopes: list[list[str]] = []  # paths made inside the open scopes, innermost last


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all derived tables made inside.

    They belong to whoever opens the scope, who writes the result out before it closes; frames
    built inside are of no use afterwards. Without a scope they stay until the shared folder is
    cleared, because a lazy frame may still read them. Streams open one per micro-batch.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_and_clear(spark: SparkSession, build, path: str, mode: str = "errorifexists") -> None:
    """Write the frame that `build` returns as Parquet, then drop the tables made on the way."""
    with scratch_scope(spark):
        build().write.mode(mode).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Cuts lineage, gives every later reader and retried task the same rows, and lets
    readers prune columns and see the true size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
