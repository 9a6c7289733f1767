"""Text corpora: named splits, plain files, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.operators.joins import measured
from corpusgauge.operators.ordering import key_bits, ranked, running_offset
from corpusgauge.session import materialise

TEXT_FORMATS = {"csv": "csv", "json": "json", "txt": "text"}


def load_corpus(spark: SparkSession, path: str, split: str | None = None, key: str = "row_id") -> DataFrame:
    """A Parquet corpus; `split` filters on the split column and prunes its folders.

    `key` names the unique integer column that orders the rows; it becomes `row_id`.
    """
    df = spark.read.parquet(path).withColumnRenamed(key, "row_id")
    return df.where(F.col("split") == split) if split is not None else df


def number_rows(scan: DataFrame, name: str = "row_id", opens: str | None = None) -> DataFrame:
    """Number the rows of a file scan 0, 1, 2.. by file path and position in the file.

    `opens` names a further column, true for the first row of each file.

    Digits in a path count as numbers, so `part-99999` comes before `part-100000`. A split's
    rows are read in order, so only the splits are sorted and counted: one small row each,
    ranked by a distributed sort and added up in buckets, and the texts are not shuffled.
    """
    placed = scan.select(
        *scan.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = placed.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    order = ranked(splits.withColumn("_name", natural_order("_file")), F.asc("_name"), F.asc("_file"), F.asc("_split"), name="_at")
    starts = running_offset(order, "_at", "_n", "_base", key_bits(order, "_at")).select(
        "_file", "_split", "_first", (F.col("_base") - F.col("_first")).alias("_shift")
    )
    # `_file` and `_split` are hot by nature, a split's rows being many; ids are dense per split.
    rows, _, small = measured(starts)
    side = F.broadcast(starts) if small else starts
    first = [((F.col("_split") == 0) & (F.col("_seq") == F.col("_first"))).alias(opens)] if opens else []
    return placed.join(side, ["_file", "_split"]).select((F.col("_seq") + F.col("_shift")).alias(name), *scan.columns, *first)


def natural_order(path: Column | str) -> Column:
    """A sort key in which runs of digits compare as numbers: each is led by its length."""
    digits = F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1))
    others = F.split(path, r"\d+")

    def led(run: Column) -> Column:
        short = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(short).cast("string"), 4, "0"), short)

    pairs = F.zip_with(others, digits, lambda a, b: F.concat(a, F.coalesce(led(b), F.lit(""))))
    return F.array_join(pairs, "")


def file_kind(path: str) -> str:
    extension = path.rsplit(".", 1)[-1]
    if extension not in TEXT_FORMATS:
        raise ValueError(f"expected a csv, json or txt file, got {path!r}")
    return TEXT_FORMATS[extension]


def load_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, numbered: bool = False) -> DataFrame:
    """A csv file with a header whose quoted fields hold line breaks, read by many tasks.

    A line opens a record if an even number of quotes stands before it, which a running sum over the
    numbered lines tells; a doubled quote inside a field counts twice and changes nothing. The lines
    of a record are joined again and parsed by Spark. Lines are what is split and shuffled, so a
    file may be any size; a record is one row. Fields that are never closed are refused.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = materialise(number_rows(scan, "_row", opens="_opens"))
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = materialise(lines.select("_row", "_opens", quotes.alias("_quotes")))
    if (counted.agg(F.sum("_quotes")).first()[0] or 0) % 2:
        raise ValueError(f"a quoted field in {path!r} is not closed")
    bits = key_bits(counted, "_row")
    begins = running_offset(counted, "_row", "_quotes", "_ahead", bits).select(
        "_row", (F.col("_ahead") % 2 == 0).cast("int").alias("_begins"), (F.col("_opens") & (F.col("_ahead") % 2 == 0)).alias("_head")
    )
    placed = running_offset(begins, "_row", "_begins", "_record", bits)
    record = (F.col("_record") + F.col("_begins") - 1).alias("_record")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))), lambda x: x["value"]), "\n")
    texts = lines.select("_row", "value").join(placed.select("_row", record, "_head"), "_row").groupBy("_record").agg(
        F.rtrim(whole, F.lit("\r")).alias("value"), F.bool_or("_head").alias("_head"), F.min("_row").alias("row_id")
    )
    rows = texts.where((F.col("value") != "") & ~F.col("_head"))
    # Without these two the parser takes a line break for the record's end, and trims fields.
    options = {"escape": '"', "multiLine": "true", "lineSep": "\x00", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = rows.select("row_id", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    if numbered:
        index = running_offset(parsed, "row_id", F.lit(1), "_index", bits)
        return index.select(F.col("_index").alias("row_id"), "r.*")
    return parsed.select("r.*")


def load_file(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    keep_linebreaks: bool = True,
    numbered: bool = False,
    multi_line: bool | str = True,
) -> DataFrame:
    """Read a csv, json-lines or txt file, chosen by extension.

    Text files give one `text` row per line; the terminator Spark drops is put back
    when `keep_linebreaks` is set. `numbered` adds the `row_id` other operators order by.
    A csv file whose fields hold line breaks is read by one task; `multi_line=False` says
    that there are none, and lets a big file be split; `multi_line="split"` reads a big file
    that has some by many tasks, and needs a schema.
    """
    kind = file_kind(path)
    if kind == "csv" and multi_line == "split":
        if schema is None:
            raise ValueError("a csv file read in splits needs a schema")
        return load_quoted_csv(spark, path, schema, numbered)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "text":
        df = spark.read.text(path)
    elif kind == "csv":
        df = reader.csv(path, header=True, multiLine=multi_line, escape='"')
    else:
        df = reader.json(path)
    if numbered:
        df = number_rows(df)
    if kind != "text":
        return df
    value = F.concat("value", F.lit("\n")) if keep_linebreaks else F.col("value")
    return df.select(*[c for c in df.columns if c != "value"], value.alias("text"))


def load_files(
    spark: SparkSession,
    train: str | None = None,
    validation: str | None = None,
    schema: T.StructType | None = None,
    keep_linebreaks: bool = True,
    numbered: bool = False,
    multi_line: bool | str = True,
) -> dict[str, DataFrame]:
    """Train and validation files by split name; both must have allowed extensions."""
    paths = {k: v for k, v in (("train", train), ("validation", validation)) if v is not None}
    if not paths:
        raise ValueError("need a train or a validation file")
    for path in paths.values():
        file_kind(path)
    kinds = {file_kind(p) for p in paths.values()}
    if len(kinds) > 1:
        raise ValueError("train and validation files must have the same extension")
    return {k: load_file(spark, p, schema, keep_linebreaks, numbered, multi_line) for k, p in paths.items()}


def text_column(df: DataFrame) -> str:
    """`text` when present, else the first column."""
    return "text" if "text" in df.columns else df.columns[0]


def stream_corpus(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """An unbounded corpus read file by file as files arrive in `path`."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)
