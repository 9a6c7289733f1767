"""Generation logs, task results, run histories and profiler summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.functions import numbers as N
from corpusgauge.operators import accuracy, generation, history, joins, report, rows
from corpusgauge.plans.common import SQL_GENERATIONS, collection, generations, table

QUERIES, ORACLE, query = collection()


def rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "latency_per_sample",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, prompt_id, n_tokens, elapsed_s / n_tokens AS latency,
    n_tokens / elapsed_s AS throughput FROM gen WHERE n_tokens > 0 AND NOT is_warmup""",
)
def latency_per_sample(spark, sf):
    out = generation.latency(rows.drop_warmup(generations(spark, sf)))
    return out.select("run_id", "prompt_id", "n_tokens", "latency", "throughput")


@query(
    "latency_assumed",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, prompt_id, elapsed_s / 64.0::DOUBLE AS latency,
    64.0::DOUBLE / elapsed_s AS throughput FROM gen""",
)
def latency_assumed(spark, sf):
    out = generation.latency_assumed(generations(spark, sf), 64)
    return out.select("run_id", "prompt_id", "latency", "throughput")


@query(
    "empty_generations_dropped",
    f"WITH {SQL_GENERATIONS} SELECT run_id, count(*) AS n FROM gen WHERE n_tokens > 0 GROUP BY run_id",
)
def empty_generations_dropped(spark, sf):
    kept = rows.drop_empty_generations(generations(spark, sf))
    return kept.groupBy("run_id").agg(F.count("*").alias("n"))


@query(
    "micro_average",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, count(*) AS samples, round(sum(elapsed_s) / sum(n_tokens), 9) AS latency,
    round(sum(n_tokens) / sum(elapsed_s), 9) AS throughput FROM gen WHERE n_tokens > 0 AND NOT is_warmup GROUP BY run_id""",
)
def micro_average(spark, sf):
    out = generation.average(rows.drop_warmup(generations(spark, sf)), "micro", ["run_id"])
    return rounded(out, "latency", "throughput")


@query(
    "macro_average",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, count(*) AS samples, round(avg(elapsed_s / n_tokens), 9) AS latency,
    round(avg(n_tokens / elapsed_s), 9) AS throughput FROM gen WHERE n_tokens > 0 GROUP BY run_id""",
)
def macro_average(spark, sf):
    return rounded(generation.average(generations(spark, sf), "macro", ["run_id"]), "latency", "throughput")


@query(
    "macro_full_denominator",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, count(*) AS samples,
    round(sum(CASE WHEN n_tokens >= 5 THEN elapsed_s / n_tokens END) / count(*), 9) AS latency,
    round(sum(CASE WHEN n_tokens >= 5 THEN n_tokens / elapsed_s END) / count(*), 9) AS throughput FROM gen GROUP BY run_id""",
)
def macro_full_denominator(spark, sf):
    out = generation.average(generations(spark, sf), "macro_full", ["run_id"], kept=F.col("n_tokens") >= 5)
    return rounded(out, "latency", "throughput")


@query(
    "batch_weighted",
    f"""WITH {SQL_GENERATIONS} SELECT run_id, count(*) AS samples,
    round(sum(elapsed_s / (64 * batch_size) * batch_size) / sum(batch_size), 9) AS latency,
    round(sum(64 * batch_size / elapsed_s * batch_size) / sum(batch_size), 9) AS throughput FROM gen GROUP BY run_id""",
)
def batch_weighted(spark, sf):
    batches = generations(spark, sf).withColumn("n_tokens", F.col("batch_size") * 64)
    return rounded(generation.average(batches, "batch_weighted", ["run_id"]), "latency", "throughput")


@query(
    "speedup_vs_baseline",
    f"""WITH {SQL_GENERATIONS}, m AS (SELECT run_id,
      sum(elapsed_s) FILTER (mode = 'baseline') / sum(n_tokens) FILTER (mode = 'baseline') AS b,
      sum(elapsed_s) FILTER (mode = 'assisted') / sum(n_tokens) FILTER (mode = 'assisted') AS a
      FROM gen WHERE n_tokens > 0 AND NOT is_warmup GROUP BY run_id)
    SELECT run_id, round(b, 9) AS baseline_latency, round(a, 9) AS assisted_latency, round(b / a, 9) AS speedup FROM m""",
)
def speedup_vs_baseline(spark, sf):
    out = generation.speedup(rows.drop_warmup(generations(spark, sf)), by=["run_id"])
    return rounded(out, "baseline_latency", "assisted_latency", "speedup")


@query(
    "paired_runs",
    f"""WITH {SQL_GENERATIONS}, t AS (SELECT prompt_id, mode, sum(n_tokens) AS k, sum(elapsed_s) AS s FROM gen WHERE n_tokens > 0 GROUP BY 1, 2)
    SELECT b.prompt_id, CAST(b.k AS BIGINT) AS baseline_tokens, round(b.s, 6) AS baseline_seconds,
    CAST(a.k AS BIGINT) AS assisted_tokens, round(a.s, 6) AS assisted_seconds, round((b.s / b.k) / (a.s / a.k), 9) AS speedup
    FROM t b JOIN t a ON a.prompt_id = b.prompt_id AND b.mode = 'baseline' AND a.mode = 'assisted'""",
)
def paired_runs(spark, sf):
    pairs = generation.pair_runs(generations(spark, sf))
    ratio = N.per_token("baseline_seconds", "baseline_tokens") / N.per_token("assisted_seconds", "assisted_tokens")
    return rounded(pairs.withColumn("speedup", F.round(ratio, 9)), "baseline_seconds", "assisted_seconds", places=6)


@query(
    "step_latency_percentiles",
    """SELECT user_id AS run_id, count(value) AS steps, round(avg(value), 9) AS mean_ms, round(quantile_cont(value, 0.5), 9) AS p50_ms,
    round(quantile_cont(value, 0.95), 9) AS p95_ms FROM events GROUP BY user_id""",
)
def step_latency_percentiles(spark, sf):
    steps = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("ms"))
    return rounded(generation.step_latencies(steps), "mean_ms", "p50_ms", "p95_ms")


@query(
    "step_latency_nulls",
    """SELECT CAST(nullif(l_partkey % 5, 0) AS VARCHAR) AS run_id, count(v) AS steps, round(avg(v), 6) AS mean_ms, round(quantile_cont(v, 0.5), 6) AS p50_ms,
    round(quantile_cont(v, 0.95), 6) AS p95_ms
    FROM (SELECT l_partkey, CASE WHEN l_partkey % 5 <> 3 AND l_linenumber <> 7 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1""",
)
def step_latency_nulls(spark, sf):
    """Runs without a name or without any latency, others of many steps, some without one."""
    part = F.col("l_partkey") % 5
    timed = (part != 3) & (F.col("l_linenumber") != 7)
    steps = table(spark, sf, "lineitem").select(
        F.nullif(part, F.lit(0).cast("bigint")).cast("string").alias("run_id"), F.when(timed, F.col("l_extendedprice")).alias("ms")
    )
    return rounded(generation.step_latencies(steps), "mean_ms", "p50_ms", "p95_ms", places=6)


@query(
    "unit_conversion",
    "SELECT o_orderkey, round(o_totalprice / 1e9::DOUBLE, 12) AS gb, round(o_totalprice * 1000.0::DOUBLE, 6) AS ms FROM orders",
)
def unit_conversion(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(N.to_gb("o_totalprice"), 12).alias("gb"), F.round(N.to_ms("o_totalprice"), 6).alias("ms")
    )


SQL_RESULTS = "r AS (SELECT source AS task_id, quality = 1 AS passed FROM labels JOIN documents USING (doc_id))"
SQL_PASS = f"""{SQL_RESULTS}, t AS (SELECT task_id, count(*) AS n, count(*) FILTER (passed) AS c FROM r GROUP BY 1),
p AS (SELECT task_id, n, c, CASE WHEN c = 0 THEN 0.0 ELSE c / n END::DOUBLE AS pass_at_1,
  CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < 5 THEN 1.0::DOUBLE ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - 5.0::DOUBLE / i)) END AS pass_at_5,
  CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pass_at_n FROM t)"""


def task_results(spark, sf):
    verdicts = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    tasks = table(spark, sf, "documents").select("doc_id", F.col("source").alias("task_id"))
    return verdicts.join(tasks, "doc_id").drop("doc_id")


@query(
    "pass_at_k_per_task",
    f"WITH {SQL_PASS} SELECT task_id, n, c, round(pass_at_1, 9) AS pass_at_1, round(pass_at_5, 9) AS pass_at_5, pass_at_n FROM p",
)
def pass_at_k_per_task(spark, sf):
    return rounded(accuracy.task_pass_at_k(task_results(spark, sf), (1, 5, "n")), "pass_at_1", "pass_at_5")


@query(
    "pass_at_k",
    f"""WITH {SQL_PASS} SELECT count(*) AS tasks, round(avg(pass_at_1), 9) AS pass_at_1, round(avg(pass_at_5), 9) AS pass_at_5,
    round(avg(pass_at_n), 9) AS pass_at_n FROM p""",
)
def pass_at_k(spark, sf):
    return rounded(accuracy.pass_at_k(task_results(spark, sf), (1, 5, "n")), "pass_at_1", "pass_at_5", "pass_at_n")


@query("expand_samples", "SELECT doc_id, CAST(i AS INT) AS sample_id FROM documents, range(5) t(i)")
def expand_samples(spark, sf):
    return joins.expand_samples(table(spark, sf, "documents").select("doc_id"), 5)


@query(
    "attach_problems",
    "SELECT doc_id AS task_id, quality, n_chars FROM labels JOIN documents USING (doc_id)",
)
def attach_problems(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"), "quality")
    problems = table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), "n_chars")
    return joins.attach_problems(done, problems)


@query(
    "missing_problems",
    "SELECT doc_id AS task_id, count(*) AS n_completions FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
)
def missing_problems(spark, sf):
    done = table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"))
    problems = table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"))
    return joins.missing_problems(done, problems)


@query(
    "gpu_util_mean_by_run",
    """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS mean FROM events GROUP BY 1)
    SELECT c_custkey AS run_id, round_even(mean * 100, 0) / 100 AS mean,
    CASE WHEN user_id IS NULL THEN 'Error: no run ' || c_custkey WHEN mean IS NULL THEN 'N/A' ELSE 'ok' END AS status
    FROM customer LEFT JOIN m ON user_id = c_custkey""",
)
def gpu_util_mean_by_run(spark, sf):
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "value"
    )
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return history.attach_history(wanted, history.mean_by_run(samples, "view"))


@query(
    "gpu_util_named_runs",
    """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS mean FROM events GROUP BY 1)
    SELECT c_custkey AS run_id, c_name AS run_name, round_even(mean * 100, 0) / 100 AS mean,
    CASE WHEN user_id IS NULL THEN 'Error: no run ' || c_custkey WHEN mean IS NULL THEN 'N/A' ELSE 'ok' END AS status
    FROM customer LEFT JOIN m ON user_id = c_custkey""",
)
def gpu_util_named_runs(spark, sf):
    """The run's name stands beside its id."""
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "value"
    )
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("run_name"))
    return history.attach_history(wanted, history.mean_by_run(samples, "view"))


@query(
    "metric_column_mean",
    """SELECT 'system.gpu.0.gpu' AS metric, count(*) AS n, round(avg(value), 9) AS mean FROM events WHERE event_type = 'view'
    UNION ALL SELECT 'system.gpu.1.gpu', 0, NULL""",
)
def metric_column_mean(spark, sf):
    """The column exists with gaps in one case and is absent in the other."""
    view = F.when(F.col("event_type") == "view", F.col("value")).otherwise(F.lit(float("nan")))
    wide = table(spark, sf, "events").select(view.alias("system.gpu.0.gpu"))

    def mean(name):
        values = rows.metric_or_missing(wide, name)
        return values.agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean")).withColumn("metric", F.lit(name))

    return rows.append_rows(mean("system.gpu.0.gpu"), mean("system.gpu.1.gpu"))


@query(
    "failure_status",
    r"""WITH k AS (SELECT event_id, value, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INT) AS k FROM events)
    SELECT event_id, CASE WHEN k <> 0 THEN round(value / k, 9) END AS value,
    CASE WHEN k <> 0 THEN 'ok' ELSE 'Error: division by zero' END AS status FROM k""",
)
def failure_status(spark, sf):
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999")).cast("int")
    out = rows.with_status(table(spark, sf, "events"), F.try_divide("value", k), "value", "division by zero")
    return rounded(out, "value").select("event_id", "value", "status")


SQL_SUMMARY = """sum(v) AS total, count(v) AS n, avg(v) AS avg, quantile_cont(v, 0.5) AS med, min(v) AS min, max(v) AS max,
coalesce(stddev_samp(v), 0) AS stddev"""
SQL_SUMMARY_OUT = """n, round(100 * total / {over}, 6) AS time_pct, round(total, 4) AS total, round(avg, 6) AS avg, round(med, 6) AS med, min, max, round(stddev, 6) AS stddev"""


def summary_columns(df):
    out = rounded(df, "time_pct", "avg", "med", "stddev", places=6)
    return out.withColumn("total", F.round("total", 4))


@query(
    "profile_summary",
    f"""WITH s AS (SELECT event_type AS name, {SQL_SUMMARY} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1)
    SELECT name, {SQL_SUMMARY_OUT.format(over='sum(total) OVER ()')} FROM s ORDER BY total DESC""",
)
def profile_summary(spark, sf):
    named = table(spark, sf, "events").select(F.col("event_type").alias("name"), "value")
    return summary_columns(history.named_summary(named, "name", "value"))


@query(
    "profile_summary_by_report",
    f"""WITH s AS (SELECT l_linestatus AS report, l_partkey AS name, {SQL_SUMMARY} FROM (SELECT *, l_extendedprice AS v FROM lineitem) GROUP BY 1, 2)
    SELECT report, name, {SQL_SUMMARY_OUT.format(over='sum(total) OVER (PARTITION BY report)')} FROM s""",
)
def profile_summary_by_report(spark, sf):
    named = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("report"), F.col("l_partkey").alias("name"), F.col("l_extendedprice").alias("value")
    )
    return summary_columns(history.named_summary(named, "name", "value", "report"))


SQL_GAPS = "SELECT nullif(l_returnflag, 'R') AS report, CAST(nullif(l_partkey % 7, 0) AS VARCHAR) AS name, CASE WHEN l_partkey % 7 <> 5 AND l_linenumber <> 7 THEN l_extendedprice END AS v FROM lineitem"


@query(
    "profile_summary_nulls",
    f"""WITH s AS (SELECT report, name, {SQL_SUMMARY} FROM ({SQL_GAPS}) GROUP BY 1, 2)
    SELECT report, name, {SQL_SUMMARY_OUT.format(over='sum(total) OVER (PARTITION BY report)')} FROM s""",
)
def profile_summary_nulls(spark, sf):
    """Reports and names may be missing, and a name may have no value."""
    part = F.col("l_partkey") % 7
    value = F.when((part != 5) & (F.col("l_linenumber") != 7), F.col("l_extendedprice"))
    named = table(spark, sf, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("report"), F.nullif(part, F.lit(0).cast("bigint")).cast("string").alias("name"), value.alias("value")
    )
    return summary_columns(history.named_summary(named, "name", "value", "report"))


@query(
    "profile_summary_named_nulls",
    f"""WITH s AS (SELECT name, {SQL_SUMMARY} FROM ({SQL_GAPS.replace('l_partkey % 7, 0', 'l_linenumber % 3, 0')}) GROUP BY 1)
    SELECT name, {SQL_SUMMARY_OUT.format(over='sum(total) OVER ()')} FROM s""",
)
def profile_summary_named_nulls(spark, sf):
    """Few names, so that each has very many values."""
    value = F.when((F.col("l_partkey") % 7 != 5) & (F.col("l_linenumber") != 7), F.col("l_extendedprice"))
    named = table(spark, sf, "lineitem").select(F.nullif(F.col("l_linenumber") % 3, F.lit(0)).cast("string").alias("name"), value.alias("value"))
    return summary_columns(history.named_summary(named, "name", "value"))


@query(
    "profile_diff",
    """WITH s AS (SELECT l_linestatus AS st, l_returnflag AS report, l_partkey AS name, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    a AS (SELECT * FROM s WHERE st = 'F'), b AS (SELECT * FROM s WHERE st = 'O')
    SELECT coalesce(a.report, b.report) AS report, coalesce(a.name, b.name) AS name, round(coalesce(a.total, 0), 4) AS total_a, coalesce(a.n, 0) AS n_a,
    round(coalesce(b.total, 0), 4) AS total_b, coalesce(b.n, 0) AS n_b, round(coalesce(b.total, 0) - coalesce(a.total, 0), 4) AS total_change
    FROM a FULL JOIN b ON a.report = b.report AND a.name = b.name""",
)
def profile_diff(spark, sf):
    def side(status):
        lines = table(spark, sf, "lineitem").where(F.col("l_linestatus") == status)
        return lines.groupBy(F.col("l_returnflag").alias("report"), F.col("l_partkey").alias("name")).agg(
            F.sum("l_extendedprice").alias("total"), F.count("*").alias("n")
        )

    return rounded(joins.diff_profiles(side("F"), side("O")), "total_a", "total_b", "total_change", places=4)


SQL_SWEEP = """sweep AS (SELECT l_returnflag AS thr, l_linestatus AS sampling, l_linenumber AS k,
  avg(l_quantity) AS tp, avg(l_extendedprice) AS lat FROM lineitem GROUP BY 1, 2, 3)"""


def sweep(spark, sf):
    keys = [F.col("l_returnflag").alias("thr"), F.col("l_linestatus").alias("sampling"), F.col("l_linenumber").alias("k")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(
        F.avg("l_quantity").alias("tp"), F.avg("l_extendedprice").alias("lat")
    )


@query(
    "sweep_series",
    f"WITH {SQL_SWEEP} SELECT thr, sampling, k, round(tp, 9) AS tp, round(lat, 6) AS lat FROM sweep ORDER BY thr, sampling, k",
)
def sweep_series(spark, sf):
    out = sweep(spark, sf).select("thr", "sampling", "k", F.round("tp", 9).alias("tp"), F.round("lat", 6).alias("lat"))
    return report.series(out, ["thr", "sampling"], "k")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "sweep_pivot",
    """SELECT o_orderpriority AS q, CAST(left(o_orderpriority, 1) AS INT) - 1 AS ord, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "F",
    round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS "P"
    FROM orders GROUP BY 1, 2 ORDER BY ord""",
)
def sweep_pivot(spark, sf):
    prices = table(spark, sf, "orders").groupBy(
        # Labels come with non-breaking hyphens, as report labels may.
        report.plain_hyphens(F.translate("o_orderpriority", "-", "‑")).alias("q"),
        F.col("o_orderstatus").alias("s"),
    ).agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    return joins.reindex(report.pivot_metric(prices, "q", "s", "v", ["F", "O", "P"]), "q", PRIORITIES)


@query(
    "sweep_unpivot",
    f"""WITH {SQL_SWEEP} SELECT thr, sampling, k, 'tp' AS metric, round(tp, 6) AS value FROM sweep
    UNION ALL SELECT thr, sampling, k, 'lat', round(lat, 6) FROM sweep""",
)
def sweep_unpivot(spark, sf):
    return rounded(report.melt(sweep(spark, sf), ["thr", "sampling", "k"], ["tp", "lat"]), "value", places=6)
