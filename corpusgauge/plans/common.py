"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions import text as X
from corpusgauge.operators.ordering import key_range, range_bits
from corpusgauge.session import setting

SEPARATOR = "\n\n"


def collection() -> tuple[dict, dict, Callable]:
    """A module's queries, their SQL, and the decorator that enters both under one name."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql_by_name: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                sql_by_name[name] = sql
            return fn

        return register

    return queries, sql_by_name, query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the folder, dealt over `spark.corpusgauge.scanTasks` tasks if the caller sets that.

    A file of one row group is read by one task, and so are all its texts split; a big table is read
    by many tasks anyway, so nothing is dealt unless asked for.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    tasks = int(setting(spark, "scanTasks", 0))
    return df.repartition(tasks) if tasks else df


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", *more)


def document_bounds(spark: SparkSession, sf: str) -> tuple[int, int]:
    return key_range(table(spark, sf, "documents"), "doc_id")


def document_bits(spark: SparkSession, sf: str) -> int:
    return range_bits(*document_bounds(spark, sf))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as prompts, the assistant turn right after as completion.

    Turns meet on (conversation, turn), so a very long conversation is no hot key.
    """
    turns = table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    # One number names a sample; ids that do not fit it are refused instead of wrapping.
    fits = (F.abs("conv_id") < F.lit(1 << 31)) & F.col("turn").between(0, (1 << 32) - 1)
    sample = F.when(fits, F.shiftleft("conv_id", 32) + F.col("turn")).otherwise(
        F.raise_error(F.lit("conversation id or turn too large for a sample id")).cast("bigint")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(sample.alias("sample_id"), "prompt", "completion")


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines read as a generation log: quantity - 1 tokens, price / 10000 seconds."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_orderkey").alias("prompt_id"),
        F.when(F.col("l_linestatus") == "O", "assisted").otherwise("baseline").alias("mode"),
        (F.col("l_linenumber") == 1).alias("is_warmup"),
        F.col("l_linenumber").cast("bigint").alias("batch_size"),
        (F.col("l_quantity").cast("bigint") - 1).alias("n_tokens"),
        (F.col("l_extendedprice") / 10000.0).alias("elapsed_s"),
    )


def joined(ids: Column | str) -> Column:
    return F.concat_ws(" ", X.as_column(ids).cast("array<string>"))


# --- SQL side -------------------------------------------------------------------

BLANK_SET = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def sql_words(col: str) -> str:
    return f"regexp_extract_all({col}, '[^{BLANK_SET}]+')"


def sql_strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^[{BLANK_SET}]+', ''), '[{BLANK_SET}]+$', '')"


SQL_SAMPLES = """samples AS (
  SELECT u.conv_id * 4294967296 + u.turn AS sample_id, u.text AS prompt, a.text AS completion
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

SQL_GENERATIONS = """gen AS (
  SELECT l_suppkey AS run_id, l_orderkey AS prompt_id,
         CASE WHEN l_linestatus = 'O' THEN 'assisted' ELSE 'baseline' END AS mode,
         l_linenumber = 1 AS is_warmup, CAST(l_linenumber AS BIGINT) AS batch_size,
         CAST(l_quantity AS BIGINT) - 1 AS n_tokens, l_extendedprice / 10000.0::DOUBLE AS elapsed_s
  FROM lineitem)"""


@cache
def sql_vocab(source: str = "documents", col: str = "text") -> str:
    return f"""vocab AS (
  SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS id
  FROM (SELECT unnest({sql_words(col)}) AS word FROM {source}) GROUP BY word)"""


@cache
def sql_doc_tokens() -> str:
    """Every document word with its place in the document."""
    return f"""tok AS (
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
  FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))"""


def gappy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which every seventh is blank."""
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return documents(spark, sf).withColumn("text", text)


SQL_GAPPY = "gappy AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS text FROM documents)"


@cache
def sql_space_stream(source: str = "gappy") -> str:
    """A corpus joined by spaces: no separator is a token."""
    return f"""flat AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token
  FROM (SELECT doc_id, {sql_words('text')} AS w FROM {source})), stream AS (
  SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token,
         lag(token) OVER (ORDER BY doc_id, i) AS prev FROM flat)"""


@cache
def sql_stream(bos: bool = False) -> str:
    """The joined corpus as positions, tokens and previous tokens."""
    sep = "chr(10) || chr(10)"
    opening = "CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN ['<s>'] ELSE [] END || " if bos else ""
    return f"""rows AS (
  SELECT doc_id, {opening}{sql_words('text')}
         || CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) THEN [{sep}] ELSE [] END AS w
  FROM documents), flat AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM rows), stream AS (
  SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token,
         lag(token) OVER (ORDER BY doc_id, i) AS prev FROM flat)"""


@cache
def sql_nll(stream: str = "stream", keys: str = "pos") -> str:
    """Add-one bigram losses of a stream that has (token, prev)."""
    return f"""pairs AS (SELECT prev, token, count(*) AS n FROM {stream} WHERE prev IS NOT NULL GROUP BY 1, 2),
ctx AS (SELECT prev, sum(n) AS ctx_n FROM pairs GROUP BY 1),
v AS (SELECT count(DISTINCT token) AS v FROM {stream}),
nll AS (SELECT {', '.join('s.' + k for k in keys.split(','))}, s.token, s.prev,
  -ln((p.n + 1.0::DOUBLE) / (c.ctx_n + 1.0::DOUBLE * v.v)) AS nll
  FROM {stream} s CROSS JOIN v LEFT JOIN pairs p ON p.prev = s.prev AND p.token = s.token
  LEFT JOIN ctx c ON c.prev = s.prev)"""
