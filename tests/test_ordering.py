"""Row order, joins and percentiles against brute force, on skewed and odd keys."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import joins, ordering, quantiles
from conftest import rows_of


@pytest.mark.parametrize(
    "keys",
    [
        list(range(50)),
        [-(2**62), -5, -1, 0, 3, 2**40, 2**62, 2**62 + 1],
        [i * 4096 for i in range(30)] + [7, 8, 9, 2**33],
        [],
    ],
)
def test_running_offset_on_any_keys(spark, keys):
    rng = random.Random(7)
    sizes = {k: rng.randint(0, 9) for k in keys}
    df = spark.createDataFrame([(k, sizes[k]) for k in rng.sample(keys, len(keys))], "k long, n int")
    got = rows_of(ordering.running_offset(df, "k", "n"), "k", "offset")
    total, want = 0, []
    for k in sorted(keys):
        want.append((k, total))
        total += sizes[k]
    assert got == want


def test_fewer_levels_give_the_same_index(spark):
    df = spark.range(0, 20000, 7).withColumnRenamed("id", "k")
    bits = ordering.key_bits(df, "k")
    assert bits == 15
    a = rows_of(ordering.with_row_index(df, "k", bits=bits))
    assert a == rows_of(ordering.with_row_index(df, "k")) == [(k, i) for i, k in enumerate(range(0, 20000, 7))]


def test_upper_levels(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROW_BITS", 2)
    monkeypatch.setattr(ordering, "TOTAL_BITS", 2)
    df = spark.range(3, 900, 5).withColumnRenamed("id", "k")
    assert rows_of(ordering.with_row_index(df, "k", bits=10)) == [(k, i) for i, k in enumerate(range(3, 900, 5))]


def test_ranked(spark):
    df = spark.createDataFrame([(i % 5, f"w{i:03d}") for i in range(200)], "n int, w string").repartition(7)
    got = rows_of(ordering.ranked(df, F.desc("n"), F.asc("w")), "rank", "w")
    want = sorted(((i % 5, f"w{i:03d}") for i in range(200)), key=lambda t: (-t[0], t[1]))
    assert got == [(i, w) for i, (_, w) in enumerate(want)]


def test_sort_limit_share(spark):
    df = spark.createDataFrame([(0, 3, "x"), (1, 1, "x"), (2, 3, "y"), (3, 1, "y")], "row_id long, n int, g string")
    assert [r.row_id for r in ordering.sort_by_length(df, "n").collect()] == [1, 3, 0, 2]
    assert [r.row_id for r in ordering.limit_n(df, 2).collect()] == [0, 1]
    assert ordering.limit_n(df, 0).count() == 4
    assert rows_of(ordering.share_of_total(df, "n"), "row_id", "time_pct")[0] == (0, 37.5)
    assert rows_of(ordering.share_of_total(df, "n", ["g"]), "row_id", "time_pct")[0] == (0, 75.0)


@pytest.mark.parametrize("n,stride,ctx", [(1, 4, 8), (10, 4, 8), (16, 4, 4), (9, 4, 2), (3, 4, 8)])
def test_stride_windows_and_prev_end(spark, n, stride, ctx):
    df = spark.range(1).select(F.inline(ordering.stride_windows(F.lit(n), stride, ctx)))
    want, prev = [], 0
    for begin in range(0, n, stride):
        end = min(begin + ctx, n)
        want.append((begin // stride, begin, end, prev))
        prev = end
    assert rows_of(df) == want
    again = ordering.prev_end(df.drop("prev_end"))
    assert rows_of(again, "window", "begin", "end", "prev_end") == want


@pytest.mark.parametrize("way", ["small", "once", "twice", "twice with few"])
def test_lookup_on_hot_and_null_keys(spark, monkeypatch, way):
    if way != "small":
        monkeypatch.setattr(joins, "SMALL_ROWS", 100 if way == "twice with few" else 0)
        monkeypatch.setattr(joins, "HOT_KEYS", 4)
        monkeypatch.setattr(joins, "SERVED_SHARE", 2.0 if way == "once" else 0.0)
    words = ["the"] * 400 + ["of"] * 150 + [f"w{i}" for i in range(300)] + [None] * 40 + ["absent"]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos long, word string")
    known = {w: i for i, w in enumerate(sorted({w for w in words if w and w != "absent"}))}
    right = spark.createDataFrame([(w, i, words.count(w)) for w, i in known.items()], "word string, id int, n long")
    got = rows_of(joins.lookup(left, right, ["word"], "n", ["pos"]), "pos", "id")
    assert got == [(i, known.get(w)) for i, w in enumerate(words)]


@pytest.mark.parametrize("rows", [3, joins.SMALL_ROWS + 1])
def test_attach_narrow(spark, rows):
    wide = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, [])], "k long, tokens array<string>")
    narrow = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "k long, offset long")
    assert rows_of(joins.attach_narrow(wide, narrow, "k", rows)) == [(1, ["a"], 0), (2, ["b", "c"], 1), (3, [], 3)]


def test_lookup_sorts_when_a_task_cannot_hold_the_table(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    monkeypatch.setattr(joins, "HASH_ROWS", 0)
    left = spark.range(300).select(F.col("id").alias("pos"), F.concat(F.lit("w"), F.col("id") % 50).alias("word"))
    right = spark.range(50).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id"), F.lit(6).alias("n"))
    out = joins.lookup(left, right, ["word"], "n", ["pos"])
    assert out.where(F.col("word") == F.concat(F.lit("w"), "id")).count() == 300


def test_heaviest_keys_fit_the_bounds(spark, monkeypatch):
    table = spark.createDataFrame([(f"w{i}", 100 // (i + 1)) for i in range(50)], "word string, n long")
    total = sum(100 // (i + 1) for i in range(50))
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    monkeypatch.setattr(joins, "SMALL_ROWS", 5)
    least, share = joins.heaviest(table, "n", total)
    assert least == 20 and share == pytest.approx((100 + 50 + 33 + 25 + 20) / total)
    monkeypatch.setattr(joins, "SMALL_BYTES", 0)
    assert joins.heaviest(table, "n", total) == (total + 1, 0.0)
    monkeypatch.setattr(joins, "HOT_KEYS", 6)
    assert joins.heaviest(table, "n", total)[0] == 100


def test_hot_side_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    left = spark.range(1000).select(F.col("id").alias("pos"), F.lit("the").alias("word"))
    right = spark.createDataFrame([("the", 1, 1000)] + [(f"w{i}", i, 1) for i in range(2, 500)], "word string, id int, n long")
    out = joins.lookup(left, right, ["word"], "n", ["pos"])
    assert out.where("id = 1").count() == 1000
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_expand_attach_missing(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    assert rows_of(joins.expand_samples(tasks, 2)) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert joins.expand_samples(tasks, 0).count() == 0
    done = spark.createDataFrame([("a", 0), ("c", 0), ("c", 1)], "task_id string, sample_id int")
    assert rows_of(joins.attach_problems(done, tasks)) == [("a", 0)]
    assert rows_of(joins.missing_problems(done, tasks)) == [("c", 2)]


def test_reindex(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "q string, v int")
    assert [r.q for r in joins.reindex(df, "q", ["b", "a"]).collect()] == ["b", "a"]
    assert [r.q for r in joins.reindex(df, "q", ["a"]).collect()] == ["a"]
    with pytest.raises(Exception, match="no row for z"):
        joins.reindex(df, "q", ["a", "z"]).collect()


def test_diff_profiles(spark):
    schema = "report string, name string, total double, n long"
    a = spark.createDataFrame([("api", "x", 5.0, 2), ("api", "y", 1.0, 1)], schema)
    b = spark.createDataFrame([("api", "x", 7.0, 3), ("mem", "x", 2.0, 1)], schema)
    assert rows_of(joins.diff_profiles(a, b)) == [
        ("api", "x", 5.0, 2, 7.0, 3, 2.0), ("api", "y", 1.0, 1, 0.0, 0, -1.0), ("mem", "x", 0.0, 0, 2.0, 1, 2.0),
    ]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_percentiles(spark, monkeypatch, accuracy):
    import numpy as np

    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(0, 5) for _ in range(3000)],
        "ties": [1.0] * 500 + [2.0] * 501,
        "even": [float(i) for i in range(100)],
        "pair": [1.0, 4.0],
        "one": [2.5],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(data, "g string, v double")
    marks = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], "v", marks).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, q in marks.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), abs=1e-12)
    whole = quantiles.exact_percentiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(float(np.median([v for vs in groups.values() for v in vs])))
