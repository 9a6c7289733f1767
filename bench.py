"""Time the headline queries and print one JSON line.

Each query runs once to warm up and once for the clock; every row is computed and
dropped, so nothing but the query is timed. The test tables are single files of one row group, so
their rows are dealt over as many tasks as there are cores (`spark.corpusgauge.scanTasks`).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

from corpusgauge.plans import registry  # noqa: E402
from corpusgauge.session import local_session  # noqa: E402

HEADLINE = [
    "corpus_stats",
    "length_histogram",
    "prompts_filter_then_select",
    "vocab_fit",
    "encode_docs",
    "group_texts",
    "ngram_nll",
    "ppl_single",
    "ppl_strided_left",
    "ppl_strided_right",
    "ppl_overlap",
    "ppl_conditional",
    "next_token_accuracy",
    "last_word_accuracy",
    "acceptance_per_run",
    "micro_average",
    "speedup_vs_baseline",
    "step_latency_percentiles",
    "pass_at_k",
    "gpu_util_mean_by_run",
    "profile_summary_by_report",
    "sweep_pivot",
    "quantize_int8",
    "quantize_nf4",
    "stream_group_texts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), "bench")
    spark.conf.set("spark.corpusgauge.scanTasks", cpus if cpus.isdigit() else "0")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    line = {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds}
    print(json.dumps({**line, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
