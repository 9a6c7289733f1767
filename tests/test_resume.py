"""Keyed stream groups, resumed jobs and cached results."""

import os
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from corpusgauge.session import scratch_path
from corpusgauge.sources import cache, resume
from corpusgauge.sources.corpus import stream_corpus
from corpusgauge.streaming import groups

ROWS = StructType().add("row_idx", LongType()).add("input_ids", ArrayType(IntegerType()))


def blocks(rows, size, n):
    out = []
    for g in range(-(-len(rows) // n)):
        ids = [x for i, r in sorted(rows, key=lambda r: r[0]) if i // n == g for x in r or ()]
        out += [(g, k, ids[k * size : (k + 1) * size]) for k in range(len(ids) // size)]
    return out


@pytest.mark.parametrize("cuts", [(0, 57), (0, 3, 30, 31, 50, 57)])
def test_groups_do_not_depend_on_arrival(spark, cuts):
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 99) for _ in range(rng.randint(0, 9))]) for i in range(57)]
    rows[4], rows[11] = (4, None), (11, list(range(40)))
    order = rng.sample(rows, len(rows))
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in "abc")
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(order[a:b], ROWS).write.mode("append").parquet(arrivals)
        groups.stream_groups(stream_corpus(spark, arrivals, ROWS), 8, sink, checkpoint, 10).awaitTermination()
    done = spark.read.schema(groups.BLOCKS).parquet(sink)
    assert {r["batch"] for r in done.collect()} == set(range(5))  # whole groups only
    assert [r["batch"] for r in groups.open_groups(spark, checkpoint).collect()] == [5]
    got = done.union(groups.rest(spark, checkpoint, 8)).orderBy("batch", "block").collect()
    assert [(r["batch"], r["block"], r["input_ids"]) for r in got] == blocks(rows, 8, 10)
    assert all(r["labels"] == r["input_ids"] for r in got)


def test_rows_are_numbered_over_micro_batches(spark):
    arrivals, sink, checkpoint = (scratch_path(spark, x) for x in "abc")
    lots = [[5, 9, 7], [1], [100, 2, 50, 3]]
    for lot in lots:
        spark.createDataFrame([(k,) for k in lot], "row_id bigint").write.mode("append").parquet(arrivals)
        sdf = stream_corpus(spark, arrivals, StructType().add("row_id", LongType()))
        groups.number_stream(sdf, sink, checkpoint).awaitTermination()
    got = spark.read.schema("row_id bigint, row_idx bigint").parquet(sink).select("row_id", "row_idx").orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(k, i) for i, k in enumerate(x for lot in lots for x in sorted(lot))]


def test_a_rerun_does_the_unfinished_parts_only(spark, tmp_path):
    folder = str(tmp_path / "job")
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    parts = resume.key_parts(df, "id", 4)
    assert sorted(parts) == ["00000", "00001", "00002", "00003", "null"]

    def broken():
        return parts | {"00002": parts["00002"].withColumn("v", F.raise_error(F.lit("lost")).cast("bigint"))}

    first = resume.Job(spark, folder, {"n": 4})
    with pytest.raises(PySparkException):
        first.stage("double", broken)
    assert first.finished("double") == ["00000", "00001"]
    left = sorted(os.listdir(f"{folder}/double/part=00000"))

    second = resume.Job(spark, folder, {"n": 4})
    out = second.stage("double", lambda: parts)
    assert second.written == [("double", "00002"), ("double", "00003"), ("double", "null")]
    assert sorted(os.listdir(f"{folder}/double/part=00000")) == left
    assert out.columns == ["id", "v"] and out.agg(F.sum("v")).first()[0] == 9900

    third = resume.Job(spark, folder, {"n": 4})
    again = third.stage("double", lambda: pytest.fail("a finished stage is not built"))
    assert third.written == [] and again.count() == 100
    total = third.stage("total", lambda: {"all": again.agg(F.sum("v").alias("s"))})
    assert third.written == [("total", "all")] and total.first()["s"] == 9900


def test_a_part_without_its_commit_is_written_anew(spark, tmp_path):
    folder = str(tmp_path / "job")
    job = resume.Job(spark, folder)
    df = spark.range(10)
    df.where("id < 3").write.parquet(f"{folder}/s/part=a")  # as if the driver died before the commit
    out = job.stage("s", lambda: {"a": df.where("id < 5"), "b": df.where("id >= 5")})
    assert job.written == [("s", "a"), ("s", "b")] and out.count() == 10


def test_folders_of_others_are_refused(spark, tmp_path):
    folder = str(tmp_path / "job")
    job = resume.Job(spark, folder, {"size": 1})
    job.stage("s", lambda: {"a": spark.range(3)})
    with pytest.raises(ValueError, match="other settings"):
        resume.Job(spark, folder, {"size": 2})
    anew = resume.Job(spark, folder, {"size": 2}, overwrite=True)
    assert anew.finished("s") == []
    anew.stage("s", lambda: {"a": spark.range(3)})
    os.remove(f"{folder}/_done/s.json")
    with pytest.raises(ValueError, match="another cut"):
        anew.stage("s", lambda: {"b": spark.range(3)})
    other = tmp_path / "other"
    other.mkdir()
    assert resume.Job(spark, str(other)).finished("s") == []  # an empty folder is fine
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(ValueError, match="not empty"):
        resume.Job(spark, str(tmp_path / "full"))


def test_key_parts_hold_every_row_once(spark):
    df = spark.createDataFrame([(k,) for k in (-5, None, 3, 3, 900, None)], "id bigint")
    for n in (1, 2, 7, 5000):
        assert sum(p.count() for p in resume.key_parts(df, "id", n).values()) == 6
    assert list(resume.key_parts(df.limit(0), "id", 3)) == ["null"]


def counting(marks, by=1):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        with open(os.path.join(marks, os.urandom(8).hex()), "w"):
            pass
        return batch.assign(n=batch["id"] * by)

    return run


def test_the_second_call_computes_nothing(spark, tmp_path):
    data, folder, marks = (str(tmp_path / x) for x in ("data", "cache", "marks"))
    os.mkdir(marks)
    spark.range(20).write.parquet(data)

    def call(fn, overwrite=False):
        before = len(os.listdir(marks))
        got = cache.map_batches_cached(spark.read.parquet(data), fn, "id long, n long", folder, overwrite=overwrite)
        assert got.count() in (20, 25)
        return len(os.listdir(marks)) > before, got.agg(F.sum("n")).first()[0]

    assert call(counting(marks)) == (True, 190)
    assert call(counting(marks)) == (False, 190)
    assert call(counting(marks, 2)) == (True, 380)  # another closure
    assert call(counting(marks)) == (False, 190)
    assert call(counting(marks), overwrite=True) == (True, 190)
    spark.range(20, 25).write.mode("append").parquet(data)  # another input
    assert call(counting(marks)) == (True, 300)
    assert call(counting(marks)) == (False, 300)


def test_plans_have_names_of_their_own(spark, tmp_path):
    data = str(tmp_path / "data")
    spark.range(20).selectExpr("id", *[f"id + {k} AS c{k}" for k in range(40)]).write.parquet(data)
    read = lambda: spark.read.parquet(data)
    same = cache.result_key(read().where("c39 > 3").select("id"))
    assert cache.result_key(read().where("c39 > 3").select("id")) == same
    others = [read().where("c39 > 4").select("id"), read().where("c38 > 3").select("id"), read().where("c39 > 3").select("c1")]
    assert len({same, *map(cache.result_key, others)}) == 4
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert cache.result_key(read().where("c39 > 3").select("id")) != same
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hidden_inputs_need_a_version(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id bigint")
    with pytest.raises(ValueError, match="version"):
        cache.cached(rows, str(tmp_path))
    assert cache.cached(rows, str(tmp_path), version="1").collect() == rows.collect()
    made = spark.range(3).mapInPandas(lambda parts: parts, "id long")
    with pytest.raises(ValueError, match="version"):
        cache.result_key(made)
    assert cache.cached(spark.range(3), str(tmp_path)).count() == 3


def test_functions_are_told_apart_by_their_code():
    def one(x, y=1):
        return x + y

    def two(x, y=1):
        return x - y

    assert cache.function_key(one) == cache.function_key(one) != cache.function_key(two)
