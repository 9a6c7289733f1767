"""Sources, sinks, streams and caller hooks, end to end over the tables."""

from __future__ import annotations

from datetime import timedelta
from itertools import pairwise

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusgauge.functions import arrays as A
from corpusgauge.functions import text as X
from corpusgauge.operators import callbacks, history, ordering, rows, vocabulary
from corpusgauge.plans.common import (
    collection,
    SQL_GENERATIONS,
    SQL_SAMPLES,
    document_bits,
    documents,
    generations,
    joined,
    samples,
    sql_words,
    table,
)
from corpusgauge.plans.corpus import BLOCK, ORACLE as CORPUS_SQL, encoded_documents
from corpusgauge.session import materialise, scratch_path
from corpusgauge.sources import cache, profiles, records, resume
from corpusgauge.sources import corpus as source
from corpusgauge.streaming import groups, jobs

QUERIES, ORACLE, query = collection()


@query("load_corpus_split", "SELECT doc_id AS row_id, text FROM documents WHERE lang = 'en'")
def load_corpus_split(spark, sf):
    """Languages play the splits: written to split folders, one of them read back."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("split"))
    docs.write.partitionBy("split").parquet(path)
    return source.load_corpus(spark, path, "en", "doc_id").select("row_id", "text")


@query(
    "load_text_files",
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT line || chr(10) AS text, count(*) AS n FROM l GROUP BY 1""",
)
def load_text_files(spark, sf):
    path = scratch_path(spark, "corpus") + ".txt"
    documents(spark, sf).select("text").write.text(path)
    lines = source.load_files(spark, train=path, keep_linebreaks=True)["train"]
    column = source.text_column(lines)
    return lines.groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n"))


@query(
    "numbered_text_lines",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    f AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS text FROM d)
    SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS row_id, text FROM f""",
)
def numbered_text_lines(spark, sf):
    """Documents written in order to text files, whose lines are numbered as they are read."""
    path = scratch_path(spark, "corpus") + ".txt"
    documents(spark, sf).orderBy("doc_id").select("text").write.text(path)
    return source.load_file(spark, path, keep_linebreaks=False, numbered=True)


@query("load_json_files", "SELECT doc_id, text FROM documents")
def load_json_files(spark, sf):
    path = scratch_path(spark, "corpus") + ".json"
    docs = documents(spark, sf)
    docs.write.json(path)
    return source.load_files(spark, train=path, schema=docs.schema)["train"]


@query("load_csv_files", "SELECT doc_id, text FROM documents")
def load_csv_files(spark, sf):
    path = scratch_path(spark, "corpus") + ".csv"
    docs = documents(spark, sf)
    docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return source.load_files(spark, validation=path, schema=docs.schema)["validation"]


@query("load_csv_splits", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, text FROM documents")
def load_csv_splits(spark, sf):
    """Texts with line breaks in quoted fields, in ordered files that are read in small splits."""
    path = scratch_path(spark, "corpus") + ".csv"
    docs = documents(spark, sf)
    docs.orderBy("doc_id").write.csv(
        path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return source.load_files(spark, validation=path, schema=docs.schema, numbered=True, multi_line="split")["validation"]


@query(
    "problems_jsonl",
    "SELECT source || '/' || doc_id AS task_id, text AS prompt, lang AS test, source AS entry_point FROM documents",
)
def problems_jsonl(spark, sf):
    path = scratch_path(spark, "problems") + ".jsonl"
    docs = documents(spark, sf, "lang", "source")
    problems = docs.select(
        F.concat_ws("/", "source", "doc_id").alias("task_id"),
        F.col("text").alias("prompt"),
        F.col("lang").alias("test"),
        F.col("source").alias("entry_point"),
    )
    records.write_jsonl(rows.project(problems, *records.PROBLEM_SCHEMA.names), path)
    return records.read_problems(spark, path)


@query(
    "metric_log",
    f"""WITH {SQL_GENERATIONS}, r AS (SELECT mode, prompt_id, unnest(['n_tokens', 'system.elapsed']) AS metric,
      unnest([n_tokens::DOUBLE, elapsed_s]) AS value FROM gen)
    SELECT mode AS run_id, metric, count(*) AS n, count(DISTINCT prompt_id) AS steps, round(sum(value), 4) AS total FROM r GROUP BY 1, 2""",
)
def metric_log(spark, sf):
    path = scratch_path(spark, "log")
    logged = generations(spark, sf).select(
        F.col("mode").alias("run_id"), F.col("prompt_id").alias("step"), "n_tokens", F.col("elapsed_s").alias("system.elapsed")
    )
    # Two appends, as a run logs while it goes on.
    for mode in ("baseline", "assisted"):
        records.log_rows(logged.where(F.col("run_id") == mode), path)
    return records.read_log(spark, path).groupBy("run_id", "metric").agg(
        F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "sample_log",
    f"""WITH {SQL_SAMPLES}, r AS (SELECT sample_id, unnest(['prompt', 'generation', 'n_chars']) AS metric,
      unnest([NULL, NULL, length(completion)::DOUBLE]) AS value, unnest([left(prompt, 200) || '...', completion, NULL]) AS text FROM samples)
    SELECT sample_id AS step, metric, value, text FROM r WHERE value IS NOT NULL OR text IS NOT NULL""",
)
def sample_log(spark, sf):
    """Text values beside numbers: a prompt's preview and what was generated."""
    path = scratch_path(spark, "log")
    logged = samples(spark, sf).select(
        F.lit("run").alias("run_id"), F.col("sample_id").alias("step"), X.preview("prompt", 200).alias("prompt"),
        F.col("completion").alias("generation"), F.length("completion").alias("n_chars"),
    )
    records.log_rows(logged, path)
    return records.read_log(spark, path).select("step", "metric", "value", "text")


@query(
    "run_summary",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, CAST(sum(n_tokens) AS BIGINT) AS tokens, round(sum(elapsed_s), 6) AS seconds
    FROM gen GROUP BY run_id""",
)
def run_summary(spark, sf):
    path = scratch_path(spark, "summary")
    out = generations(spark, sf).groupBy("run_id").agg(
        F.sum("n_tokens").alias("tokens"), F.round(F.sum("elapsed_s"), 6).alias("seconds")
    )
    records.log_summary(out, path)
    return spark.read.schema(out.schema).json(path)


@query(
    "run_config",
    """SELECT s_suppkey AS run_id, unnest(['name', 'nation', 'note']) AS key, unnest([s_name, CAST(s_nationkey AS VARCHAR), NULL]) AS value FROM supplier""",
)
def run_config(spark, sf):
    runs = table(spark, sf, "supplier")
    settings = {"name": F.col("s_name"), "nation": F.col("s_nationkey"), "note": F.lit(None)}
    configs = runs.select(F.col("s_suppkey").alias("run_id"), records.config_map(settings).alias("config"))
    return configs.select("run_id", F.explode("config").alias("key", "value"))


@query(
    "history_export",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS n_rows, round(avg(value) FILTER (event_type = 'click'), 9) AS mean FROM events GROUP BY 1""",
)
def history_export(spark, sf):
    path = scratch_path(spark, "history") + ".jsonl"
    table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), "ts", F.col("event_type").alias("metric"), "value"
    ).write.json(path)
    means = history.mean_by_run(records.read_history(spark, path), "click")
    return means.withColumn("mean", F.round("mean", 9))


@query(
    "export_errors",
    """WITH r AS (SELECT user_id % 50 AS run, event_type, value, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS back FROM events),
    m AS (SELECT CAST(run AS VARCHAR) AS run_id, avg(value) FILTER (event_type = 'click') AS mean FROM r GROUP BY 1)
    SELECT run_id, CASE WHEN run_id NOT IN ('7', '11') THEN round_even(mean, 2) END AS mean,
    CASE run_id WHEN '7' THEN 'Error: 1 unreadable lines' WHEN '11' THEN 'Error: no run 11' ELSE CASE WHEN mean IS NULL THEN 'N/A' ELSE 'ok' END END AS status FROM m""",
)
def export_errors(spark, sf):
    """Exports of fifty runs, one of which is cut short and one missing."""
    folder = scratch_path(spark, "exports")
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 50).cast("string").alias("run"), "event_id",
        F.to_json(F.struct("ts", F.col("event_type").alias("metric"), "value")).alias("line"),
    )
    last = events.where("run = '7'").agg(F.max("event_id").alias("last"))
    ended = F.when((F.col("run") == "7") & (F.col("event_id") == last.scalar()), F.expr("left(line, length(line) - 9)")).otherwise(F.col("line"))
    events.where("run <> '11'").select("run", ended.alias("value")).repartition("run").write.partitionBy("run").text(folder)
    lines = records.read_exports(spark, folder, r"run=([^/]+)/")
    runs = events.select(F.col("run").alias("run_id")).distinct()
    return history.attach_exports(runs, history.mean_by_export(lines, "click"))


@query(
    "guarded_output",
    "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1",
)
def guarded_output(spark, sf):
    path = scratch_path(spark, "output")
    out = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    records.write_guarded(out, path)
    records.write_guarded(out, path, overwrite=True)
    return spark.read.schema(out.schema).parquet(path)


@query(
    "profile_reports",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) || '.txt' AS file, event_type AS name, CAST(sum(value * 100) AS BIGINT) AS total, count(*) AS n,
      max(value) AS top FROM events GROUP BY 1, 2)
    SELECT regexp_replace(file, '.txt', '') AS run, report, name, n, CASE WHEN report = 'api_sum' THEN 0.5::DOUBLE END AS time_pct,
    CASE WHEN report = 'api_sum' THEN total::DOUBLE ELSE round(total / 1000, 3) END AS total, round(top, 3) AS "max"
    FROM s, (SELECT unnest(['api_sum', 'mem_size_sum']) AS report)""",
)
def profile_reports(spark, sf):
    """Reports in the profiler's layout are written per run from the events, then parsed back."""
    per_name = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(
        F.round(F.sum(F.col("value") * 100)).cast("bigint").alias("total"), F.count("*").alias("n"), F.max("value").alias("top")
    )
    api = F.format_string("     0.5  %15d  %9d  1.0  1.0  0.0  %.3f  0.0  %s  ", "total", "n", "top", "name")
    size = F.format_string("  %9.3f  %6d  0.1  0.1  0.0  %.3f  0.0  %s  ", F.col("total") / 1000, "n", "top", "name")
    # A run has as many lines as event types.
    lines = per_name.groupBy("user_id").agg(
        F.concat_ws("\n", F.sort_array(F.collect_list(api))).alias("api"),
        F.concat_ws("\n", F.sort_array(F.collect_list(size))).alias("size"),
    )
    text = F.concat(
        F.lit("SKIPPED: no data.\n\n ** API Summary (api_sum):\n\n Time (%)  Total Time (ns)  Num Calls  Avg  Med  Min  Max  StdDev  Name\n ---  ---\n"),
        "api",
        F.lit("\n\n ** MemOps Summary (by Size) (mem_size_sum):\n\n Total (MB)  Count  Avg  Med  Min  Max  StdDev  Operation\n ---  ---\n"),
        "size",
    )
    path = scratch_path(spark, "reports")
    lines.select(F.col("user_id").alias("run"), text.alias("value")).write.partitionBy("run").text(path)
    files = spark.read.text(path, wholetext=True).select(F.col("run").cast("string").alias("file"), "value")
    out = profiles.parse_profile(files)
    return out.select(F.col("file").alias("run"), "report", "name", "n", "time_pct", "total", "max")


@query(
    "stream_words",
    f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS tokens, len({sql_words('text')}) AS n_tokens FROM documents",
)
def stream_words(spark, sf):
    sink, checkpoint = scratch_path(spark, "words"), scratch_path(spark, "state")
    schema = table(spark, sf, "documents").select("doc_id", "text").schema
    sdf = source.stream_corpus(spark, f"{sf}/documents*.parquet", schema)
    done = jobs.start(
        jobs.stream_words(sdf, "doc_id").writeStream.format("parquet").outputMode("append").option("path", sink), checkpoint
    )
    done.awaitTermination()
    out = spark.read.schema("doc_id bigint, tokens array<string>, n_tokens bigint").parquet(sink)
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query("stream_tokenise", CORPUS_SQL["encode_docs"])
def stream_tokenise(spark, sf):
    sink, checkpoint = scratch_path(spark, "ids"), scratch_path(spark, "state")
    vocab = vocabulary.fit_vocab(documents(spark, sf))
    schema = table(spark, sf, "documents").select("doc_id", "text").schema
    sdf = source.stream_corpus(spark, f"{sf}/documents*.parquet", schema)
    jobs.stream_tokenise(sdf, vocab, sink, checkpoint, "doc_id").awaitTermination()
    out = spark.read.schema("doc_id bigint, input_ids array<int>").parquet(sink)
    return out.select("doc_id", joined("input_ids").alias("ids"), F.size("input_ids").cast("bigint").alias("n"))


@query("stream_group_texts", CORPUS_SQL["group_texts"])
def stream_group_texts(spark, sf):
    """Encoded documents arrive as one file, hence one micro-batch, as in the batch query."""
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in ("encoded", "blocks", "state"))
    encoded = encoded_documents(spark, sf)
    encoded.write.parquet(arrivals)
    sdf = source.stream_corpus(spark, arrivals, encoded.schema)
    jobs.stream_group_texts(sdf, BLOCK, sink, checkpoint, key="doc_id").awaitTermination()
    out = spark.read.schema("batch bigint, block bigint, input_ids array<int>, labels array<int>").parquet(sink)
    return out.select("batch", "block", joined("input_ids").alias("ids"), joined("labels").alias("labels"))


ARRIVALS = (0, 1, 3, 4, 9, 16)  # sixteenths of the rows that have come before each of five arrivals


@query("stream_groups", CORPUS_SQL["group_texts"])
def stream_groups(spark, sf):
    """Encoded documents arrive out of order, in five uneven lots, each met by a stream started anew."""
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in ("encoded", "blocks", "state"))
    encoded = materialise(encoded_documents(spark, sf))
    numbered = materialise(ordering.with_row_index(encoded, "doc_id", bits=document_bits(spark, sf)).select("row_idx", "input_ids"))
    lot = F.pmod(F.xxhash64("row_idx"), F.lit(16))
    for low, high in pairwise(ARRIVALS):
        numbered.where((lot >= low) & (lot < high)).write.mode("append").parquet(arrivals)
        sdf = source.stream_corpus(spark, arrivals, numbered.schema)
        groups.stream_groups(sdf, BLOCK, sink, checkpoint).awaitTermination()
    out = spark.read.schema(groups.BLOCKS).parquet(sink).union(groups.rest(spark, checkpoint, BLOCK))
    return out.select("batch", "block", joined("input_ids").alias("ids"), joined("labels").alias("labels"))


@query("stream_row_index", "SELECT doc_id, row_number() OVER (ORDER BY (doc_id % 3), doc_id) - 1 AS row_idx FROM documents")
def stream_row_index(spark, sf):
    """Rows numbered in the order they arrive: three lots, and by id inside each."""
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in ("rows", "numbered", "state"))
    docs = documents(spark, sf).select("doc_id")
    for lot in range(3):
        docs.where(F.col("doc_id") % 3 == lot).write.mode("append").parquet(arrivals)
        sdf = source.stream_corpus(spark, arrivals, docs.schema)
        groups.number_stream(sdf, sink, checkpoint, "doc_id").awaitTermination()
    return spark.read.schema("doc_id bigint, row_idx bigint").parquet(sink).select("doc_id", "row_idx")


@query("resumed_output", f"SELECT lang, count(*) AS n_docs, CAST(sum(len({sql_words('text')})) AS BIGINT) AS n_words FROM documents GROUP BY 1")
def resumed_output(spark, sf):
    """A job of two stages that fails in the third part of the first, and is run again."""
    folder = scratch_path(spark, "job")
    ranges = resume.key_parts(documents(spark, sf, "lang"), "doc_id", 4)

    def run(broken: str | None = None):
        job = resume.Job(spark, folder, {"parts": 4})

        def counted(name, part):
            n = X.word_count("text")
            if name == broken:
                n = F.raise_error(F.lit("lost")).cast("int")
            return part.select("lang", n.cast("bigint").alias("n_words"))

        words = job.stage("words", lambda: {name: counted(name, part) for name, part in ranges.items()})
        total = words.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
        return job.stage("total", lambda: {"all": total})

    try:
        run(broken=sorted(ranges)[2])
    except PySparkException:
        return run()
    raise RuntimeError("the first run should have failed")


@query("map_batches_cached", f"SELECT doc_id, len({sql_words('text')}) AS n FROM documents")
def map_batches_cached(spark, sf):
    """The second call finds what the first one kept, and reads no document."""
    folder = scratch_path(spark, "cache")

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "n": batch["text"].str.split().str.len()})

    for _ in range(2):
        out = cache.map_batches_cached(documents(spark, sf), count, "doc_id long, n long", folder)
    return out


@query(
    "stream_metrics",
    "SELECT event_type AS run_id, metric, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, unnest(['value', 'user']) AS metric, unnest([value, user_id::DOUBLE]) AS value FROM events) GROUP BY 1, 2",
)
def stream_metrics(spark, sf):
    sink, checkpoint = scratch_path(spark, "metrics"), scratch_path(spark, "state")
    schema = table(spark, sf, "events").schema
    sdf = source.stream_corpus(spark, f"{sf}/events*.parquet", schema)
    steps = sdf.select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), "value", F.col("user_id").alias("user")
    )
    jobs.stream_metrics(steps, sink, checkpoint).awaitTermination()
    return records.read_log(spark, sink).groupBy("run_id", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "stream_metrics_once",
    "SELECT event_type AS run_id, event_id AS step, 'value' AS metric, value FROM events WHERE value IS NOT NULL",
)
def stream_metrics_once(spark, sf):
    """Runs that stop twice and go on a day's steps earlier, an hour after they first logged them."""
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "metrics", "state"))
    steps = table(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), "value", "ts")
    low, high = steps.agg(F.min("ts"), F.max("ts")).first()
    stops = [low + (high - low) * k / 3 for k in range(3)] + [high]
    for k, (begin, end) in enumerate(pairwise(stops)):
        first = steps.where((F.col("ts") > begin if k else F.lit(True)) & (F.col("ts") <= end))
        again = steps.where((F.col("ts") > begin - timedelta(days=1)) & (F.col("ts") <= begin))
        repeated = again.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
        (first.union(repeated) if k else first).write.mode("append").parquet(arrivals)
        sdf = source.stream_corpus(spark, arrivals, steps.schema)
        jobs.stream_metrics_once(sdf, sink, checkpoint, delay="2 days").awaitTermination()
    return records.read_log(spark, sink).select("run_id", "step", "metric", "value")


@query("map_batches", f"SELECT doc_id, len({sql_words('text')}) AS n FROM documents")
def map_batches(spark, sf):
    def count(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "n": batch["text"].str.split().str.len()})

    return callbacks.map_batches(documents(spark, sf), count, "doc_id long, n long")


@query("prepared_scores", "SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings")
def prepared_scores(spark, sf):
    """Score arrays reduced by a caller's expression before anything is shuffled."""
    scored = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return callbacks.prepare_scores(scored, A.argmax, "embedding", "pred")


@query(
    "caller_metric",
    """WITH p AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings)
    SELECT label, count(*) AS n, count(DISTINCT pred) AS kinds, avg(CASE WHEN pred % 8 = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM p GROUP BY 1""",
)
def caller_metric(spark, sf):
    """A caller's metric over predictions and labels: accuracy per label."""

    def metric(df):
        hit = F.when(F.col("pred") % 8 == F.col("label"), 1.0).otherwise(0.0)
        return df.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("pred").alias("kinds"), F.avg(hit).alias("accuracy"))

    return callbacks.metric_fn(prepared_scores(spark, sf), metric)


@query("where_fn", f"SELECT doc_id FROM documents WHERE len({sql_words('text')}) >= 128")
def where_fn(spark, sf):
    def long_enough(text: pd.Series) -> pd.Series:
        return text.str.split().str.len() >= 128

    return rows.where_fn(documents(spark, sf), long_enough, "text").select("doc_id")


@query(
    "tokenize_with",
    f"SELECT doc_id, array_to_string(list_transform({sql_words('text')}, lambda x: length(x)), ' ') AS ids FROM documents",
)
def tokenize_with(spark, sf):
    """A caller's encoder; this one codes a word by its length."""

    def encode(texts: list[str]) -> list[list[int]]:
        return [[len(w) for w in t.split()] for t in texts]

    return vocabulary.tokenize_with(documents(spark, sf), encode, "doc_id").select("doc_id", joined("input_ids").alias("ids"))


@query(
    "complete",
    f"""WITH {SQL_SAMPLES} SELECT sample_id AS prompt_id, CAST(i AS INT) AS sample_id, array_to_string({sql_words('prompt')}[1:16], ' ') AS completion,
    least(len({sql_words('prompt')}), 16) AS n_tokens FROM samples, range(2) t(i)""",
)
def complete(spark, sf):
    """A caller's predictor; this one repeats the prompt's first tokens."""

    def echo(prompts: list[str], max_tokens: int) -> list[list[str]]:
        return [p.split()[:max_tokens] for p in prompts]

    prompts = samples(spark, sf).select(F.col("sample_id").alias("prompt_id"), "prompt")
    return callbacks.complete(prompts, echo, 16, 2).drop("elapsed_s")
