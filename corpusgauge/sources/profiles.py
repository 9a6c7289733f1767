"""Profiler summary reports: fixed-width text with several named sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of the profiler's text report.
SECTION_MARK = r"(?m)^ \*\* "
SECTION_NAME = r"\((\w+)\):"
NUMBER = r"(-?[\d.]+)"
TIMED_ROW = r"^\s+" + r"\s+".join([NUMBER] * 8) + r"\s+(\S.*)$"
SIZED_ROW = r"^\s+" + r"\s+".join([NUMBER] * 7) + r"\s+(\S.*)$"
TIMED_FIELDS = ("time_pct", "total", "n", "avg", "med", "min", "max", "stddev")
SIZED_FIELDS = ("total", "n", "avg", "med", "min", "max", "stddev")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of every section; skipped sections give none.

    A report is a few hundred lines, so each file is read whole and unfolded in place:
    no shuffle, and any number of files.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value"
    )
    return parse_profile(files)


def parse_profile(files: DataFrame) -> DataFrame:
    """Rows of `(file, value)` report texts as typed summary rows."""
    # What stands before the first mark holds no section.
    sections = files.select(
        "file", F.explode(F.slice(F.split("value", SECTION_MARK), F.lit(2), F.lit(1 << 30))).alias("section")
    )
    lines = sections.select(
        "file",
        F.regexp_extract("section", SECTION_NAME, 1).alias("report"),
        F.contains(F.col("section"), F.lit("Time (%)")).alias("has_pct"),
        F.explode(F.split("section", "\n")).alias("line"),
    )
    rows = lines.where(F.rlike("line", F.lit(SIZED_ROW)))

    def field(name: str) -> Column:
        timed = F.regexp_extract("line", TIMED_ROW, TIMED_FIELDS.index(name) + 1)
        if name not in SIZED_FIELDS:
            return F.when(F.col("has_pct"), timed)
        sized = F.regexp_extract("line", SIZED_ROW, SIZED_FIELDS.index(name) + 1)
        return F.when(F.col("has_pct"), timed).otherwise(sized)

    name = F.when(F.col("has_pct"), F.regexp_extract("line", TIMED_ROW, 9)).otherwise(
        F.regexp_extract("line", SIZED_ROW, 8)
    )
    return rows.select(
        "file",
        "report",
        *[
            field(f).cast("bigint" if f == "n" else "double").alias(f)
            for f in TIMED_FIELDS
        ],
        F.rtrim(name).alias("name"),
    )
