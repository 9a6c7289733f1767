"""Results kept by what they are made of: the plan, its input files and their versions.

A result's name is a hash of the query plan without its running numbers, of the settings that change
values, of every input file's path, length and time of change, and of a caller's function. The same
query over the same files finds its result, and no input is read; a changed file, plan or function
has another name and is computed. A result is written under a draft's name and then renamed.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import types
import uuid
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.operators.callbacks import map_batches
from corpusgauge.session import delete
from corpusgauge.sources.resume import exists, rename

# Settings that change what an expression gives.
TELLING = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.caseSensitive")
FULL = "spark.sql.debug.maxToStringFields"
# Inputs and functions that a plan names but does not show.
HIDDEN = re.compile(
    r"\b(LogicalRDD|LocalRelation|InMemoryRelation|ExternalRDD|StreamingRelation|JDBCRelation|scalar-subquery)\b"
    r"|InPandas|InArrow|PythonUDF|pythonUDF|PythonDataSource|ScalaUDF|UDF\("
)


def plan_text(df: DataFrame) -> str:
    """The analysed plan, with the numbers that Spark gives expressions counted from one."""
    spark = df.sparkSession
    had = spark.conf.get(FULL)
    spark.conf.set(FULL, str(1 << 24))  # else wide plans are shortened
    try:
        told = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(FULL, had)
    numbers: dict[str, str] = {}
    return re.sub(r"#(\d+)", lambda m: "#" + numbers.setdefault(m[1], str(len(numbers) + 1)), told)


def function_key(fn: Callable) -> str:
    """A hash of a function's code, defaults and closure. Functions it calls from modules count by name."""
    if inspect.isfunction(fn):
        own = types.FunctionType(fn.__code__, fn.__globals__, fn.__name__, fn.__defaults__, fn.__closure__)
        own.__kwdefaults__, own.__module__, own.__qualname__ = fn.__kwdefaults__, "__main__", fn.__name__
        fn = own  # as if typed in: the code itself is pickled, not its module's name
    return hashlib.sha256(cloudpickle.dumps(fn)).hexdigest()


def input_versions(df: DataFrame) -> tuple:
    """Count and hash sums of the input files' paths, lengths and times; files are listed, not opened."""
    paths = [unquote(p) for p in df.inputFiles()]
    if not paths:
        return ()
    files = df.sparkSession.read.format("binaryFile").load(paths).select("path", "modificationTime", "length")
    own = F.xxhash64("path", "modificationTime", "length")
    return tuple(map(str, files.agg(F.count("*"), F.sum(own.cast("decimal(38,0)")), F.bit_xor(own)).first()))


def result_key(df: DataFrame, version: str | None = None) -> str:
    """The name under which a result is kept.

    `version` stands for what the plan does not show: rows made in memory, a Python function, a
    subquery's files, a source that is no file. A plan with any of these is refused without it.
    """
    told = plan_text(df)
    if version is None and (found := HIDDEN.search(told)):
        raise ValueError(f"the plan does not show all it depends on ({found[0]}); pass a version")
    conf = df.sparkSession.conf
    parts = (told, df.schema.json(), *input_versions(df), *(conf.get(k) for k in TELLING), df.sparkSession.version, version or "")
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def cached(df: DataFrame, folder: str, version: str | None = None, overwrite: bool = False) -> DataFrame:
    """The frame's rows from the cache folder, computed and kept there first if they are not."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{result_key(df, version)}"
    if overwrite or not exists(spark, path):
        draft = f"{path}.draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        delete(spark, path)
        rename(spark, draft, path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches_cached(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, folder: str, workers: int | None = None, overwrite: bool = False
) -> DataFrame:
    """`map_batches`, kept by the input's plan and files, the schema and the function's code."""
    version = f"{function_key(fn)} {schema} {result_key(df)}"
    return cached(map_batches(df, fn, schema, workers), folder, version, overwrite)
