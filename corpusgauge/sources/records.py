"""Problems, completions, run histories, metric logs and run outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.operators.ordering import limit_n
from corpusgauge.sources.corpus import number_rows

PROBLEM_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("task_id", "prompt", "test", "entry_point")]
)


def read_problems(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Problem records from JSON lines; `limit` keeps the first tasks in file order."""
    df = spark.read.schema(PROBLEM_SCHEMA).json(path)
    if limit is None:
        return df
    return limit_n(number_rows(df, "_at"), limit, "_at").drop("_at") if limit > 0 else df.limit(0)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_history(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Exported system history `(run_id, ts, metric, value)`, in JSON lines or Parquet."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        schema = "run_id string, ts timestamp, metric string, value double"
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.parquet(path)
    return df.where(F.col("run_id") == run_id) if run_id is not None else df


EXPORT = "ts timestamp, metric string, value double"


def read_exports(spark: SparkSession, folder: str, name: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """`(run_id, ts, metric, value, unread)`: every line of every run's export, good or bad.

    `name` finds the run in a file's path. Lines are parsed where they are read; one that is no
    record, such as the last of a file cut short, is kept as text in `unread` instead of ending
    the job. An empty file has no line, so its run is as good as absent.
    """
    run = F.regexp_extract(F.col("_metadata.file_path"), name, 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(run.alias("run_id"), "value").where("run_id <> ''")
    kind = T.StructType.fromDDL(f"{EXPORT}, _bad string")
    record = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select("run_id", "value", record.alias("r"))
    # A line of blanks is no record either, but says nothing; a value of another type leaves the record's text in _bad.
    bad = F.when(F.trim("value") == "", None).when(F.col("r").isNull(), F.col("value")).otherwise(F.col("r._bad"))
    good = bad.isNull()
    return parsed.select("run_id", *[F.when(good, F.col(f"r.{c}")).alias(c) for c in ("ts", "metric", "value")], bad.alias("unread"))


def wide_to_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """Columns, dotted names included, turned into `(ids.., metric, value, text)` rows.

    Numbers and booleans go to `value`, strings (a prompt, a generation) to `text`.
    """
    def entry(name: str) -> Column:
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        column, none = F.col(f"`{name}`"), F.lit(None)
        value, text = (none.cast("double"), column) if is_text else (column.cast("double"), none.cast("string"))
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), text.alias("text"))

    rows = df.select(*ids, F.inline(F.array(*[entry(c) for c in df.columns if c not in ids])))
    return rows.where(F.col("value").isNotNull() | F.col("text").isNotNull())


def log_rows(df: DataFrame, path: str, ids: tuple[str, ...] = ("run_id", "step")) -> None:
    """Append per-sample metrics in long form; a run's steps share a folder.

    Rebalancing gathers a run's rows into few files and splits a run that is very long.
    """
    long = wide_to_long(df, list(ids)).hint("rebalance", F.col("run_id"))
    long.write.mode("append").partitionBy("run_id").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step bigint, metric string, value double, text string, run_id string").parquet(path)


def log_summary(df: DataFrame, path: str) -> None:
    """One row per run, appended as JSON."""
    df.write.mode("append").json(path)


def log_config(spark: SparkSession, run_id: str, config: Mapping[str, object]) -> DataFrame:
    """A run's settings as one `(run_id, config map)` row; None stays null."""
    settings = {k: None if v is None else str(v) for k, v in config.items()}
    schema = "run_id string, config map<string,string>"
    return spark.createDataFrame([(run_id, settings)], schema)


def config_map(settings: Mapping[str, Column]) -> Column:
    """The same map built from columns, for frames that hold many runs."""
    pairs = [x for k, v in settings.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def write_guarded(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuse to write over an existing non-empty output unless told to; an empty folder is fine."""
    if overwrite or is_empty_folder(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
        return
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_ALREADY_EXISTS":
            raise ValueError(f"output {path!r} exists and is not empty; pass overwrite=True") from err
        raise


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) == 0
