"""Run metrics, acceptance, histories, reports, quantisation and hooks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import accept_rate
from corpusgauge.operators import (
    callbacks,
    corpus_stats,
    generation,
    history,
    joins,
    ngram,
    quantize,
    report,
    speculation,
)
import sweeps
from conftest import rows_of


@pytest.fixture(scope="module")
def log(spark):
    data = [
        ("r", "baseline", 0, 10, 2.0, 1), ("r", "baseline", 1, 20, 3.0, 3), ("r", "baseline", 2, 0, 1.0, 4),
        ("r", "assisted", 0, 10, 1.0, 1), ("r", "assisted", 1, 30, 3.0, 1),
    ]
    return spark.createDataFrame(data, "run_id string, mode string, prompt_id long, n_tokens int, elapsed_s double, batch_size int")


def test_latency(log):
    got = rows_of(generation.latency(log), "mode", "prompt_id", "latency", "throughput")
    assert got[0] == ("assisted", 0, 0.1, 10.0) and len(got) == 4
    assumed = generation.latency_assumed(log, 4)
    assert rows_of(assumed, "elapsed_s", "latency", "throughput")[-1] == (3.0, 0.75, 4 / 3)


def test_averages(log):
    base = log.where("mode = 'baseline'")
    micro = generation.average(base, "micro").first()
    assert (micro.samples, micro.latency, micro.throughput) == (2, pytest.approx(5 / 30), pytest.approx(6.0))
    assert micro.latency * micro.throughput == pytest.approx(1.0)
    macro = generation.average(base, "macro").first()
    assert macro.latency == pytest.approx((0.2 + 0.15) / 2)
    full = generation.average(base, "macro_full").first()
    assert full.samples == 3 and full.latency == pytest.approx((0.2 + 0.15) / 3)
    batch = generation.average(base.where("n_tokens > 0"), "batch_weighted").first()
    assert batch.latency == pytest.approx((0.2 * 1 + 0.15 * 3) / 4)
    equal = log.withColumn("n_tokens", F.lit(5))
    assert generation.average(equal, "micro").first().latency == pytest.approx(generation.average(equal, "macro").first().latency)
    with pytest.raises(ValueError):
        generation.average(base, "median")


def test_speedup_and_pairs(log):
    r = generation.speedup(log).first()
    assert r.speedup == pytest.approx((5 / 30) / (4 / 40))
    assert rows_of(generation.speedup(log, by=["run_id"]), "run_id")[0] == ("r",)
    assert rows_of(generation.pair_runs(log)) == [(0, 10, 2.0, 10, 1.0), (1, 20, 3.0, 30, 3.0)]


def test_step_latencies(spark):
    df = spark.createDataFrame([("r", float(i)) for i in range(101)] + [("s", 7.0)], "run_id string, ms double")
    assert rows_of(generation.step_latencies(df)) == [("r", 101, 50.0, 50.0, 95.0), ("s", 1, 7.0, 7.0, 7.0)]


def test_verify_and_acceptance(spark):
    data = [(1, 0, p, d, t) for p, (d, t) in enumerate([(5, 5), (6, 6), (7, 8)])]
    data += [(1, 1, p, d, t) for p, (d, t) in enumerate([(1, 1), (2, 2), (3, 3)])]
    data += [(1, 2, p, d, t) for p, (d, t) in enumerate([(1, 2), (2, 2), (3, 3)])] + [(2, 0, 0, None, 4)]
    df = spark.createDataFrame(data, "sample long, step long, pos long, draft int, target int")
    steps = speculation.verify_draft(df)
    assert rows_of(steps) == [(1, 0, 3, 2), (1, 1, 3, 3), (1, 2, 3, 0), (2, 0, 1, 0)]
    one = speculation.acceptance(steps, ["sample"]).orderBy("sample").collect()
    assert tuple(one[0]) == (1, 3, 5, 4, 2, 5 / 9) and tuple(one[1]) == (2, 1, 0, 1, 1, 0.0)
    assert one[0].accepted + one[0].rejected == 9
    eps = speculation.acceptance(steps, ["sample"], "eps").orderBy("sample").first()
    assert eps.accept_rate == pytest.approx(5 / (9 + 1e-9))
    total = generation.rollup_runs(speculation.acceptance_steps(steps).withColumn("run_id", F.lit("r")))
    assert rows_of(total) == [("r", 5, 5, 3)]
    empty = spark.range(1).select(accept_rate(F.lit(0), F.lit(0)), accept_rate(F.lit(0), F.lit(0), "eps")).first()
    assert tuple(empty) == (0.0, 0.0)


def test_mean_acceptance(spark):
    df = spark.createDataFrame([(0.5, 2), (None, None), (1.0, 0)], "accept_ratio double, rollbacks int")
    r = speculation.mean_acceptance(df).first()
    assert math.isnan(r.mean_accept) and r.mean_rollbacks == pytest.approx(2 / 3)
    assert speculation.mean_acceptance(df, ignore_missing=True).first().mean_accept == 0.75


def test_histories(spark):
    data = [("a", "gpu", 90.0), ("a", "gpu", float("nan")), ("a", "gpu", 80.005), ("b", "cpu", 5.0)]
    h = spark.createDataFrame(data, "run_id string, metric string, value double")
    runs = spark.createDataFrame([("a",), ("b",), ("a ",)], "run_id string")
    got = rows_of(history.attach_history(runs, history.mean_by_run(h, "gpu")), "run_id", "mean", "status")
    assert got == [("a", float(np.round(np.mean([90.0, 80.005]), 2)), "ok"), ("a ", None, "Error: no run a "), ("b", None, "N/A")]


def test_named_summary_matches_a_published_row(spark):
    # The two calls of one published profiler row, and its printed deviation and median.
    df = spark.createDataFrame(
        [("api", "free", 2143902.0), ("api", "free", 13481385.0), ("api", "once", 100.0), ("mem", "copy", 5.0)],
        "report string, name string, value double",
    )
    out = history.named_summary(df, "name", "value", "report").collect()
    assert [(r.report, r.name) for r in out] == [("api", "free"), ("api", "once"), ("mem", "copy")]
    assert round(out[0].stddev, 1) == 8016811.1 and out[0].med == 7812643.5
    assert out[1].stddev == 0.0 and out[2].time_pct == 100.0
    assert out[0].time_pct + out[1].time_pct == pytest.approx(100.0)


def test_sweep_speedups_follow_from_throughput(spark):
    off = 0
    for name in ("draft_1b", "draft_3b", "quantized_1b", "quantized_3b"):
        df = sweeps.sweep_table(spark, name)
        ratio = generation.speed_ratio("tp", sweeps.BASELINE_THROUGHPUT)
        off += df.where(F.abs(ratio - F.col("speed")) > 0.001).count()
        assert df.where(F.abs(F.col("tp") * F.col("lat") - 1000) > 1).count() == 0
    assert off == 1  # one published speed-up disagrees with its throughput


def test_report_tables(spark):
    acc = sweeps.sweep_table(spark, "accuracy").withColumn("q", report.plain_hyphens("q"))
    wide = report.pivot_metric(acc, "q", "sampling", "acc", ["greedy", "sampled"])
    ordered = joins.reindex(wide, "q", ["4-bit", "8-bit", "16-bit"])
    assert [(r.q, r.greedy, r.sampled) for r in ordered.collect()] == [
        ("4-bit", 0.292, 0.317), ("8-bit", 0.323, 0.329), ("16-bit", 0.336, 0.329),
    ]
    assert ordered.join(sweeps.sweep_table(spark, "quantized"), "q").count() == 3
    draft = sweeps.sweep_table(spark, "draft_1b")
    lines = report.series(draft, ["thr", "sampling"], "k").collect()
    assert [r.k for r in lines] == [3, 5, 7] * 4 and lines[0].thr == 1e-4
    long = report.melt(draft, ["thr", "sampling", "k"], ["tp", "acc"])
    assert long.count() == 24 and long.where("metric = 'acc' and k = 3 and thr = 0.2 and not sampling").first().value == 0.609
    assert [r.thr for r in corpus_stats.distinct_sorted(draft, "thr").collect()] == [1e-4, 0.2]


def test_corpus_stats(spark):
    texts = ["", " a b ", "c", "\n", "d e f", "g"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    r = corpus_stats.corpus_stats(df).first()
    assert tuple(r) == (6, 4, 2.5, 1.75, 1, 3, 1.5)
    ends = {x.which: (x.row_id, x.tokens, x.text) for x in corpus_stats.extreme_rows(df).collect()}
    assert ends == {"shortest": (2, 1, "c"), "longest": (4, 3, "d e f")}
    assert corpus_stats.count_at_least(df, 2).first().n_rows == 2
    assert corpus_stats.effective_samples(df, 4).first().samples == 4
    assert corpus_stats.effective_samples(df, None).first().samples == 6
    assert corpus_stats.extreme_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 100], [5, 5, 5], list(range(0, 501)), [0.1 * i for i in range(70)]])
def test_histogram_is_numpys(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = corpus_stats.histogram(df, "x", 50).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r.n for r in got] == counts.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1].hi == edges[-1]


@pytest.mark.parametrize("bits", [8, 4])
def test_quantize(spark, bits):
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=n).astype("float32") for n in (64, 100, 1)] + [np.zeros(8, "float32")]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<float>")
    levels = np.array(quantize.NF4_LEVELS)
    for r in quantize.quantize(df, "v", bits).collect():
        x = vectors[r.id].astype("float64")
        if bits == 8:
            s = np.abs(x).max()
            codes = np.rint(x * 127 / s) if s else np.zeros(len(x))
            back = codes * s / 127
            size = len(x) + 4
        else:
            s = np.concatenate([np.full(min(64, len(x) - b), np.abs(x[b : b + 64]).max()) for b in range(0, len(x), 64)])
            scaled = np.divide(x, s, out=np.zeros_like(x), where=s > 0)
            codes = np.abs(scaled[:, None] - levels).argmin(axis=1)
            back = levels[codes] * s
            size = math.ceil(len(x) / 2) + 4 * math.ceil(len(x) / 64)
        assert list(r.codes) == codes.astype(int).tolist()
        assert r.mse == pytest.approx(((x - back) ** 2).mean())
        assert r.ratio == pytest.approx(size / (4 * len(x)))
        if np.linalg.norm(x) > 0:
            assert r.cosine == pytest.approx(x @ back / np.linalg.norm(x) / np.linalg.norm(back))
        else:
            assert r.cosine is None
    with pytest.raises(ValueError):
        quantize.quantize(df, "v", 3)


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "prompt_id long, prompt string")
    out = callbacks.map_batches(df, lambda b: pd.DataFrame({"n": b["prompt"].str.len()}), "n long", workers=2)
    assert rows_of(out) == [(1,), (5,)]
    made = callbacks.complete(df, lambda ps, k: [p.split()[:k] for p in ps], 2, 2)
    assert rows_of(made, "prompt_id", "sample_id", "completion", "n_tokens") == [
        (1, 0, "a b", 2), (1, 1, "a b", 2), (2, 0, "d", 1), (2, 1, "d", 1),
    ]
    assert made.where("elapsed_s < 0").count() == 0
    from corpusgauge.functions.arrays import argmax
    from corpusgauge.operators.accuracy import token_accuracy

    scores = spark.createDataFrame([([0.1, 0.9], 1), ([0.7, 0.3], 1)], "scores array<double>, label int")
    ready = callbacks.prepare_scores(scores, argmax)
    assert ready.columns == ["label", "pred"]
    assert callbacks.metric_fn(ready, token_accuracy).first().accuracy == 0.5
