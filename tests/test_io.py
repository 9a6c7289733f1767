"""Sources, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgauge import session
from corpusgauge.operators import blocks, vocabulary
from corpusgauge.sources import corpus, profiles, records
from corpusgauge.streaming import jobs
from conftest import rows_of

REPORT = """
SKIPPED: trace.sqlite does not contain range data.

Processing [trace.sqlite] with [api_sum.py]...

 ** API Summary (api_sum):

 Time (%)  Total Time (ns)  Num Calls  Avg (ns)  Med (ns)  Min (ns)  Max (ns)  StdDev (ns)         Name
 --------  ---------------  ---------  --------  --------  --------  --------  -----------  ------------------
     90.0             9000          3    3000.0    2500.0       500      6000       2783.9  launchKernel
     10.0             1000          1    1000.0    1000.0      1000      1000          0.0  void f<int, T1>(T1)

Processing [trace.sqlite] with [mem_size_sum.py]...

 ** MemOps Summary (by Size) (mem_size_sum):

 Total (MB)  Count  Avg (MB)  Med (MB)  Min (MB)  Max (MB)  StdDev (MB)            Operation
 ----------  -----  --------  --------  --------  --------  -----------  ------------------------------
     12.500      4     3.125     2.000     0.500     8.000        3.351  [memcpy Host-to-Device]
"""


def test_read_profile(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(REPORT)
    got = profiles.read_profile(spark, str(tmp_path))
    assert got.count() == 6
    one = rows_of(got.where("file = 'a.txt'").na.fill(-1.0), "report", "name", "time_pct", "total", "n", "med", "max", "stddev")
    assert one == [
        ("api_sum", "launchKernel", 90.0, 9000.0, 3, 2500.0, 6000.0, 2783.9),
        ("api_sum", "void f<int, T1>(T1)", 10.0, 1000.0, 1, 1000.0, 1000.0, 0.0),
        ("mem_size_sum", "[memcpy Host-to-Device]", -1.0, 12.5, 4, 2.0, 8.0, 3.351),
    ]


def test_text_files(spark, tmp_path):
    txt, js, cs = tmp_path / "a.txt", tmp_path / "b.json", tmp_path / "c.csv"
    txt.write_text("one\n\ntwo")
    js.write_text('{"body": "x", "n": 1}\n{"body": "y", "n": 2}\n')
    cs.write_text('body,n\n"a, ""b""\nc",1\n')
    kept = corpus.load_files(spark, train=str(txt))["train"]
    assert rows_of(kept) == [("\n",), ("one\n",), ("two\n",)]
    bare = corpus.load_files(spark, validation=str(txt), keep_linebreaks=False)["validation"]
    assert rows_of(bare) == [("",), ("one",), ("two",)]
    j = corpus.load_files(spark, train=str(js))["train"]
    assert corpus.text_column(j) == "body" and j.count() == 2
    c = corpus.load_file(spark, str(cs))
    assert c.first().body == 'a, "b"\nc'
    assert corpus.text_column(kept) == "text"
    for bad in ({"train": "x.parquet"}, {}, {"train": str(txt), "validation": str(js)}):
        with pytest.raises(ValueError):
            corpus.load_files(spark, **bad)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    folder = tmp_path / "c.txt"
    folder.mkdir()
    want = []
    for name, count in (("a", 3), ("b", 400), ("c", 0), ("d", 25)):
        lines = [f"{name}{i:04d}" for i in range(count)]
        want += lines
        (folder / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = rows_of(corpus.load_file(spark, str(folder), keep_linebreaks=False, numbered=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))


def test_load_corpus_split(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, "train", "a"), (2, "test", "b")], "row_id long, split string, text string").write.partitionBy("split").parquet(path)
    assert rows_of(corpus.load_corpus(spark, path, "test"), "row_id", "text") == [(2, "b")]
    assert corpus.load_corpus(spark, path).count() == 2


def test_problems_and_completions(spark, tmp_path):
    path = str(tmp_path / "p.jsonl")
    data = [("t/0", "def f():\n", "assert", "f"), ("t/1", "é", "", "g"), ("t/2", "", "", "h")]
    problems = spark.createDataFrame(data, records.PROBLEM_SCHEMA).coalesce(1)
    records.write_jsonl(problems, path)
    assert rows_of(records.read_problems(spark, path)) == data
    assert [r.task_id for r in records.read_problems(spark, path, 2).collect()] == ["t/0", "t/1"]
    assert records.read_problems(spark, path, 0).count() == 0


def test_logs_and_config(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("r", 0, 1.5, None)], "run_id string, step long, `a.b` double, loss double")
    second = spark.createDataFrame([("r", 1, 7)], "run_id string, step long, tokens int")
    records.log_rows(first, path)
    records.log_rows(second, path)
    assert rows_of(records.read_log(spark, path), "run_id", "step", "metric", "value") == [("r", 0, "a.b", 1.5), ("r", 1, "tokens", 7.0)]
    config = records.log_config(spark, "r", {"k": 3, "draft": None, "sample": True, "thr": 0.2}).first()
    assert config.config == {"k": "3", "draft": None, "sample": "True", "thr": "0.2"}
    summary = str(tmp_path / "summary")
    records.log_summary(second, summary)
    records.log_summary(second, summary)
    assert spark.read.json(summary).count() == 2


def test_history_formats(spark, tmp_path):
    rows = spark.createDataFrame([("a", "gpu", 1.0), ("b", "gpu", 2.0)], "run_id string, metric string, value double")
    rows = rows.withColumn("ts", F.current_timestamp()).select("run_id", "ts", "metric", "value")
    rows.write.json(str(tmp_path / "h.jsonl"))
    rows.write.parquet(str(tmp_path / "h"))
    for path in ("h.jsonl", "h"):
        assert rows_of(records.read_history(spark, str(tmp_path / path), "b"), "value") == [(2.0,)]
        assert records.read_history(spark, str(tmp_path / path)).count() == 2


def test_guarded_output(spark, tmp_path):
    path = str(tmp_path / "out")
    records.write_guarded(spark.range(3), path)
    with pytest.raises(ValueError, match="not empty"):
        records.write_guarded(spark.range(4), path)
    records.write_guarded(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5


class FakeContext:
    """Just what work_dir asks of a SparkContext."""

    def __init__(self, master, conf):
        self.master, self.conf, self.folder = master, conf, None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = FakeContext(master, self.conf)


def test_work_dir_comes_from_the_session():
    cluster = FakeSession("yarn", spark_checkpoint_dir="/shared/work")
    assert session.work_dir(cluster) == "/shared/work" and cluster.sparkContext.folder == "/shared/work"
    assert session.scratch_path(cluster, "x").startswith("/shared/work/x-")
    with pytest.raises(RuntimeError):
        session.work_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert session.work_dir(local) == session.work_dir(local)


def test_materialise_keeps_rows(spark):
    df = spark.range(30).repartition(3)
    assert rows_of(session.materialise(df)) == rows_of(df)


TEXTS = [(i, " ".join(["a", "b", "c", "d"][: i % 5])) for i in range(24)]


def arrivals(spark, tmp_path, parts):
    """Each part becomes one file, so one micro-batch when files are taken one at a time."""
    folder = str(tmp_path / "in")
    for i in range(parts):
        part = [t for t in TEXTS if t[0] * parts // len(TEXTS) == i]
        spark.createDataFrame(part, "row_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return corpus.stream_corpus(spark, folder, schema, maxFilesPerTrigger=1), spark.read.parquet(folder)


def test_stream_tokenise_and_resume(spark, tmp_path):
    sdf, batch = arrivals(spark, tmp_path, 3)
    vocab = vocabulary.fit_vocab(batch)
    sink, state = str(tmp_path / "ids"), str(tmp_path / "state")
    jobs.stream_tokenise(sdf, vocab, sink, state).awaitTermination()
    want = rows_of(vocabulary.tokenize(batch, vocab))
    read = lambda: rows_of(spark.read.schema("row_id long, input_ids array<int>").parquet(sink), "row_id", "input_ids")
    assert read() == want
    # Started again on the same checkpoint, nothing is read twice.
    jobs.stream_tokenise(sdf, vocab, sink, state).awaitTermination()
    assert read() == want


def test_stream_words(spark, tmp_path):
    sdf, _ = arrivals(spark, tmp_path, 2)
    out = jobs.stream_words(sdf)
    query = out.writeStream.format("memory").queryName("words").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows_of(spark.table("words"), "row_id", "n_tokens") == [(i, len(t.split())) for i, t in TEXTS]


def test_stream_group_texts_drops_remainders_per_micro_batch(spark, tmp_path):
    sdf, batch = arrivals(spark, tmp_path, 2)
    ids = sdf.select("row_id", F.transform(F.array_remove(F.split("text", " "), ""), lambda w: F.ascii(w)).alias("input_ids"))
    sink = str(tmp_path / "blocks")
    jobs.stream_group_texts(ids, 4, sink, str(tmp_path / "state"), batch_rows=5).awaitTermination()
    got = rows_of(spark.read.schema("batch long, block long, input_ids array<int>").parquet(sink), "batch", "block", "input_ids")
    want = []
    for half in (TEXTS[:12], TEXTS[12:]):
        for b in range(0, 12, 5):
            flat = [ord(w) for _, t in half[b : b + 5] for w in t.split()]
            want += [(b // 5, i // 4, flat[i : i + 4]) for i in range(0, len(flat) - 3, 4)]
    assert got == sorted(want)


def test_stream_metrics(spark, tmp_path):
    folder = str(tmp_path / "steps")
    rows = spark.createDataFrame([("r", 0, 0.5, 2), ("r", 1, 0.25, None)], "run_id string, step long, lat double, tokens int")
    rows.write.parquet(folder)
    sink = str(tmp_path / "log")
    jobs.stream_metrics(corpus.stream_corpus(spark, folder, rows.schema), sink, str(tmp_path / "state")).awaitTermination()
    assert rows_of(records.read_log(spark, sink), "step", "metric", "value") == [(0, "lat", 0.5), (0, "tokens", 2.0), (1, "lat", 0.25)]
