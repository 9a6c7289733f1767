"""Damaged exports, steps logged twice, and csv records over several lines and splits."""

import csv
import datetime
import random

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType

from corpusgauge.operators import history
from corpusgauge.session import scratch_path
from corpusgauge.sources import corpus, records
from corpusgauge.streaming import jobs


def line(metric, value):
    return f'{{"ts": "2024-01-01T00:00:00Z", "metric": "{metric}", "value": {value}}}\n'


def test_a_damaged_export_is_an_error_row(spark, tmp_path):
    files = {
        "good": line("gpu", 10) + line("cpu", 1) + line("gpu", 20) + "\n  \n",
        "short": line("gpu", 10) + line("gpu", 30)[:-8],
        "typed": line("gpu", '"high"') + "[1]\n",
        "other": line("cpu", 5),
        "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    (tmp_path / "binary.jsonl").write_bytes(bytes(range(128, 256)) + b"\n")
    (tmp_path / "notes.txt").write_text("no export")
    lines = records.read_exports(spark, str(tmp_path))
    runs = spark.createDataFrame([(k, f"name {k}") for k in [*files, "binary", "absent"]], "run_id string, run_name string")
    got = {r["run_id"]: (r["run_name"], r["mean"], r["status"]) for r in history.attach_exports(runs, history.mean_by_export(lines, "gpu")).collect()}
    want = {
        "good": (15.0, "ok"), "short": (None, "Error: 1 unreadable lines"), "typed": (None, "Error: 2 unreadable lines"),
        "other": (None, "N/A"), "empty": (None, "Error: no run empty"), "binary": (None, "Error: 1 unreadable lines"), "absent": (None, "Error: no run absent"),
    }
    assert got == {k: (f"name {k}", *v) for k, v in want.items()}
    assert {r["run_id"]: r["n_rows"] for r in history.mean_by_export(lines, "gpu").collect()}["good"] == 3


def test_repeated_steps_are_stored_once(spark):
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in "abc")
    kind = StructType().add("run_id", StringType()).add("step", LongType()).add("loss", DoubleType()).add("ts", TimestampType())
    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)
    lots = [
        [("r", k, float(k), at(k)) for k in range(10)] + [("r", 3, -1.0, at(9)), ("q", 3, 0.5, at(3))],
        [("r", k, -2.0, at(k + 5)) for k in range(6, 13)],  # from step 6 on, again
        [("r", k, -3.0, at(k + 8)) for k in range(9, 15)],
    ]
    for lot in lots:
        spark.createDataFrame(lot, kind).write.mode("append").parquet(arrivals)
        sdf = corpus.stream_corpus(spark, arrivals, kind)
        jobs.stream_metrics_once(sdf, sink, checkpoint, delay="1 hour").awaitTermination()
    got = sorted((r["run_id"], r["step"], r["metric"]) for r in records.read_log(spark, sink).collect())
    assert got == sorted([("r", k, "loss") for k in range(15)] + [("q", 3, "loss")])
    values = {r["step"]: r["value"] for r in records.read_log(spark, sink).where("run_id = 'r'").collect()}
    assert all(values[k] == k for k in (*range(3), *range(4, 10))) and values[11] == -2.0 and values[14] == -3.0


PIECES = ['"', '""', "\n", "\r\n", ",", " ", "a", "é", "\n\n", "x y"]


def test_records_over_lines_and_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices(PIECES, k=rng.randint(1, 9))), rng.choice(["plain", "two\nlines", "q\"q"])) for k in range(400)]
    kind = StructType().add("id", LongType()).add("text", StringType()).add("tag", StringType())
    for part, own in enumerate((rows[:150], rows[150:151], [], rows[151:])):
        with open(tmp_path / f"part-{part}.csv", "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            out.writerow(["id", "text", "tag"])
            out.writerows(own)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        path = f"{tmp_path}/part-*.csv"
        got = corpus.load_file(spark, path, kind, numbered=True, multi_line="split")
        assert got.columns == ["row_id", "id", "text", "tag"]
        assert [tuple(r) for r in got.orderBy("row_id").collect()] == [(k, *r) for k, r in enumerate(rows)]
        one = corpus.load_file(spark, path, kind)  # one task a file
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got.drop("row_id").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_open_quotes_and_missing_schemas_are_refused(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text('id,text\n1,"never closed\n')
    kind = StructType().add("id", LongType()).add("text", StringType())
    with pytest.raises(ValueError, match="not closed"):
        corpus.load_file(spark, path, kind, multi_line="split")
    with pytest.raises(ValueError, match="schema"):
        corpus.load_file(spark, path, multi_line="split")
