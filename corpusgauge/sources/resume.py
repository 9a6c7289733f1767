"""Outputs that a stopped job goes on with: finished parts are kept, a rerun does the others.

A job's folder holds a folder per stage and part, and small commit files. A part counts once its
commit file stands, which is written under another name and then renamed, so a job that dies in
between leaves a part without a commit, and the rerun writes that part anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.operators.ordering import key_range
from corpusgauge.session import delete

JOB, DONE = "_job.json", "_done"  # Spark's readers pass over names that start with a low line


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    files, where = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    files, where = _place(spark, source)
    if not files.rename(where, _place(spark, target)[1]):
        raise OSError(f"cannot rename {source!r} to {target!r}")


def write_note(spark: SparkSession, path: str, note: Mapping) -> None:
    """A small JSON file that is there whole or not at all."""
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    files, where = _place(spark, draft)
    out = files.create(where)
    out.write(bytearray(json.dumps(note, sort_keys=True), "utf-8"))
    out.close()
    rename(spark, draft, path)


def read_note(spark: SparkSession, path: str) -> dict:
    files, where = _place(spark, path)
    stream = files.open(where)  # Spark's own readers pass over such names
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Job:
    """A folder of stages. `settings` must be the same in every run that adds to it.

    A folder with a job in it is gone on with; one that holds anything else is refused, as is
    a job of other settings. `overwrite` starts anew.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Mapping[str, object] | None = None, overwrite: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        wanted = json.loads(json.dumps(dict(settings or {}), sort_keys=True, default=str))
        if overwrite:
            delete(spark, self.folder)
        job = f"{self.folder}/{JOB}"
        if exists(spark, job):
            if read_note(spark, job) != wanted:
                raise ValueError(f"{folder!r} holds a job of other settings; pass overwrite=True to start anew")
        elif listed(spark, self.folder):
            raise ValueError(f"output {folder!r} exists and is not empty; pass overwrite=True")
        else:
            write_note(spark, job, wanted)
        self.written: list[tuple[str, str]] = []  # parts that this run wrote

    def _commit(self, stage: str, part: str) -> str:
        return f"{self.folder}/{DONE}/{stage}/{part}.json"

    def finished(self, stage: str) -> list[str]:
        """Parts of a stage that are committed."""
        return [n.removesuffix(".json") for n in listed(self.spark, f"{self.folder}/{DONE}/{stage}") if n.endswith(".json")]

    def stage(self, name: str, parts: Callable[[], Mapping[str, DataFrame]]) -> DataFrame:
        """Write the parts that are not committed yet, one job after the other, and read all of them.

        `parts` is not called once the stage is finished. All parts have one schema; a stage may
        read what an earlier one returned.
        """
        whole = f"{self.folder}/{DONE}/{name}.json"
        if not exists(self.spark, whole):
            frames, done = parts(), set(self.finished(name))
            if stray := done - set(frames):
                raise ValueError(f"stage {name!r} has finished parts of another cut: {sorted(stray)}")
            for part, df in frames.items():
                if part not in done:
                    df.write.mode("overwrite").parquet(f"{self.folder}/{name}/part={part}")
                    write_note(self.spark, self._commit(name, part), {"part": part})
                    self.written.append((name, part))
            schema = next(iter(frames.values())).schema.jsonValue() if frames else T.StructType().jsonValue()
            write_note(self.spark, whole, {"parts": sorted(frames), "schema": schema})
        note = read_note(self.spark, whole)
        schema = T.StructType.fromJson(note["schema"])
        if not note["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/part={p}" for p in note["parts"]])


def key_parts(df: DataFrame, key: str, n: int) -> dict[str, DataFrame]:
    """A table in up to n ranges of an integer key, as filters that reach the scan; null keys are a part."""
    low, high = key_range(df, key)
    parts = {}
    if low is not None:
        width = max(1, -(-(high - low + 1) // n))
        starts = range(low, high + 1, width)
        parts = {f"{k:05d}": df.where(F.col(key).between(a, min(a + width - 1, high))) for k, a in enumerate(starts)}
    return parts | {"null": df.where(F.col(key).isNull())}
