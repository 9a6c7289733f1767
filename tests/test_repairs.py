"""Missing keys, large-table branches, scratch tables and file order."""

import os
import random

import numpy as np
import pytest
from conftest import rows_of
from corpusgauge import session
from corpusgauge.operators import blocks, callbacks, generation, history, ngram, ordering, quantiles
from corpusgauge.sources import corpus, records
from corpusgauge.streaming import jobs
from pyspark.sql import functions as F


@pytest.fixture
def bounds(spark):
    def set_(**values):
        for k, v in values.items():
            spark.conf.set(f"spark.corpusgauge.{k}", str(v))

    yield set_
    for k in ("smallRows", "smallBytes", "hashRows", "hotKeys", "accuracy"):
        spark.conf.unset(f"spark.corpusgauge.{k}")


@pytest.mark.parametrize("accuracy", [10_000, 30])
def test_percentiles_of_missing_keys_ties_and_skew(spark, bounds, accuracy):
    bounds(accuracy=accuracy, smallRows=3)
    rng = random.Random(1)
    groups = {
        (None, "a"): [rng.expovariate(1) for _ in range(700)],
        ("x", None): [5.0] * 900 + [7.0],
        (None, None): [float(k % 3) for k in range(600)],
        ("y", "b"): [1e9] + [rng.random() for _ in range(400)],
        ("z", "c"): [2.0, 4.0],
    }
    data = [(a, b, v) for (a, b), vs in groups.items() for v in vs] + [("none", "d", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, h string, v double")
    marks = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = {(r.g, r.h): r for r in quantiles.exact_percentiles(df, ["g", "h"], "v", marks).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, q in marks.items():
            assert got[key][name] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)


def test_runs_without_name_or_latency_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "run_id string, ms double")
    got = {r.run_id: (r.steps, r.mean_ms, r.p50_ms) for r in generation.step_latencies(df).collect()}
    assert got == {"a": (2, 2.0, 2.0), "b": (0, None, None), None: (1, 5.0, 5.0)}


def test_summaries_keep_missing_names_and_reports(spark):
    df = spark.createDataFrame([("r", "a", 1.0), ("r", None, 3.0), (None, "a", 2.0), (None, "b", None)], "rep string, name string, v double")
    got = {(r.rep, r.name): (r.n, r.total, r.time_pct, r.med) for r in history.named_summary(df, "name", "v", "rep").collect()}
    assert got == {("r", "a"): (1, 1.0, 25.0, 1.0), ("r", None): (1, 3.0, 75.0, 3.0), (None, "a"): (1, 2.0, 100.0, 2.0), (None, "b"): (0, None, None, None)}


def test_named_runs_keep_their_columns(spark):
    means = spark.createDataFrame([("a", 2, 1.005)], "run_id string, n_rows long, mean double")
    runs = spark.createDataFrame([("a", "first"), ("b", "second")], "run_id string, run_name string")
    assert rows_of(history.attach_history(runs, means), "run_id", "run_name", "status") == [("a", "first", "ok"), ("b", "second", "Error: no run b")]


@pytest.mark.parametrize("small", [False, True])
def test_last_before_over_buckets(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ordering, "ROW_BITS", 2)
        monkeypatch.setattr(ordering, "TOTAL_BITS", 2)
    rng = random.Random(4)
    keys = sorted(rng.sample(range(5000), 200))
    data = [(k, None if rng.random() < 0.7 else f"w{k}") for k in keys]
    want, last = [], None
    for k, v in data:
        want.append((k, v, last))
        last = v or last
    df = spark.createDataFrame(data, "k long, v string")
    assert rows_of(ordering.last_before(df, "k", "v", "prev", 13)) == want


def test_texts_joined_by_spaces(spark):
    data = [(1, "a b"), (2, " \n"), (3, None), (4, "c"), (9, "d e")]
    df = spark.createDataFrame(data, "row_id long, text string")
    words = "a b c d e".split()
    want = sorted((w, p) for w, p in zip(words, [None, *words]))
    got = sorted(((r.token, r.prev) for r in ngram.corpus_bag(df, "row_id", separator=" ").collect()))
    assert got == want
    stream, n = ngram.corpus_stream(df, "row_id", separator=" ")
    assert n == 5 and [(r.pos, r.token, r.prev) for r in stream.orderBy("pos").collect()] == [
        (k, w, words[k - 1] if k else None) for k, w in enumerate(words)
    ]


def test_first_rows_beyond_what_a_task_gathers(spark, monkeypatch):
    monkeypatch.setattr(ordering, "GATHERED", 2)
    df = spark.range(50).withColumnRenamed("id", "row_id").repartition(5)
    assert [r.row_id for r in ordering.limit_n(df, 7).collect()] == list(range(7))
    assert ordering.limit_n(df, 80).count() == 50


def test_parallel_arrays_and_the_block_cap(spark):
    rows = [(k, [k] * (k % 4), [k % 2] * (k % 4)) for k in range(30)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>, attention_mask array<int>")
    made = session.materialise(blocks.group_texts(df, 4, batch_rows=10, parallel=["attention_mask"]))
    want = []
    for b in range(3):
        ids = [x for _, i, _ in rows[10 * b : 10 * b + 10] for x in i]
        want += [(b, k, ids[4 * k : 4 * k + 4], [x % 2 for x in ids[4 * k : 4 * k + 4]]) for k in range(len(ids) // 4)]
    assert rows_of(made, "batch", "block", "input_ids", "attention_mask") == want
    for n in (1, 5, 99, 0, None):
        assert rows_of(blocks.first_blocks(made, n), "batch", "block") == [w[:2] for w in (want[:n] if n else want)]


def test_a_metric_must_aggregate(spark, monkeypatch):
    df = spark.range(20)
    assert callbacks.metric_fn(df, lambda d: d.agg(F.sum("id").alias("s"))).first().s == 190
    monkeypatch.setattr(callbacks, "MOST_RESULTS", 10)
    with pytest.raises(ValueError, match="aggregate"):
        callbacks.metric_fn(df, lambda d: d)


def test_text_values_in_the_log(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, "say hi", 3, True), ("r", 1, None, None, None)], "run_id string, step long, prompt string, n int, ok boolean")
    records.log_rows(df, str(tmp_path / "log"))
    got = rows_of(records.read_log(spark, str(tmp_path / "log")).na.fill(-1.0, ["value"]).na.fill("-", ["text"]), "metric", "value", "text")
    assert got == [("n", 3.0, "-"), ("ok", 1.0, "-"), ("prompt", -1.0, "say hi")]


def test_an_empty_folder_is_no_output(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    records.write_guarded(spark.range(3), str(path))
    with pytest.raises(ValueError, match="not empty"):
        records.write_guarded(spark.range(3), str(path))
    assert spark.read.parquet(str(path)).count() == 3


def test_files_are_numbered_by_their_numbers(spark, tmp_path):
    names = ["part-99999", "part-100000", "part-7", "part-0010"]
    for k, name in enumerate(names):
        (tmp_path / f"{name}.txt").write_text(f"{name} one\n{name} two\n")
    got = corpus.number_rows(spark.read.text(f"{tmp_path}/*.txt")).orderBy("row_id").collect()
    want = [f"{n} {w}" for n in ("part-7", "part-0010", "part-99999", "part-100000") for w in ("one", "two")]
    assert [r.value for r in got] == want and [r.row_id for r in got] == list(range(8))


def files_in(folder):
    return [f for _, _, names in os.walk(folder) for f in names]


def test_scopes_leave_no_derived_table(spark, tmp_path, monkeypatch):
    work = tmp_path / "work"
    work.mkdir()
    monkeypatch.setattr(session, "work_dir", lambda _: str(work))
    df = spark.createDataFrame([(k, [k] * 5) for k in range(40)], "row_id long, input_ids array<int>")
    session.write_and_clear(spark, lambda: blocks.group_texts(session.materialise(df), 8), str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).count() == 25 and not files_in(work)
    df.write.parquet(str(tmp_path / "in"))
    sdf = corpus.stream_corpus(spark, str(tmp_path / "in"), df.schema)
    for k in range(2):
        jobs.stream_group_texts(sdf, 8, str(tmp_path / f"sink{k}"), str(tmp_path / f"state{k}")).awaitTermination()
        assert not files_in(work)
