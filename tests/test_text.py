"""Text scalars and row filters against Python's own string methods."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgauge.functions import arrays as A
from corpusgauge.functions import numbers as N
from corpusgauge.functions import text as X
from corpusgauge.operators import ordering, rows
from conftest import rows_of

TEXTS = ["", "  ", "one", " a  b ", "a\nb\tc", "x y", "\x1clead", "tail　", "a b\r\nc", "é ü", "​zero"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")


def check_like_python(spark, texts):
    got = frame(spark, texts).select(
        "text",
        X.strip("text").alias("strip"),
        X.words("text").alias("words"),
        X.word_count("text").alias("n"),
        X.newline_to_space("text").alias("flat"),
        X.first_words("text", 2).alias("two"),
        X.preview("text", 3).alias("preview"),
    )
    for r in got.collect():
        t = r.text
        assert r.strip == t.strip()
        assert list(r.words) == t.split()
        assert r.n == len(t.split())
        assert r.flat == t.replace("\n", " ")
        assert r.two == " ".join(t.split()[:2])
        assert r.preview == t[:3] + "..."


def test_text_scalars(spark):
    check_like_python(spark, TEXTS)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12), min_size=20, max_size=40))
def test_text_scalars_on_any_text(spark, texts):
    check_like_python(spark, texts)


def test_blanks_are_pythons():
    assert set(X.BLANKS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_nonblank_and_minimums(spark):
    df = frame(spark, ["  ", " a b c d ", "a b c d e", "abcd", " "])
    assert rows_of(rows.strip_nonblank(df)) == [(1, "a b c d"), (2, "a b c d e"), (3, "abcd")]
    assert rows_of(rows.min_words(df, 5), "row_id") == [(2,)]
    assert rows_of(rows.min_chars(rows.strip_nonblank(df), 5), "row_id") == [(1,), (2,)]
    ids = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2])], "row_id long, input_ids array<int>")
    assert rows_of(rows.min_tokens(ids, 3), "row_id") == [(1,)]


def test_prepare_prompts(spark):
    df = frame(spark, ["ab\ncd", "a\nb", "one two three four"])
    assert rows_of(rows.prepare_prompts(df, 3), "row_id", "prompt") == [(0, "ab cd"), (2, "one two three")]


def test_last_word_split(spark):
    df = frame(spark, ["one", "", "a b", " x  y\nz "])
    assert rows_of(rows.last_word_split(df), "row_id", "prefix", "target") == [(2, "a", "b"), (3, "x y", "z")]
    got = df.where("row_id >= 2").select(X.all_but_last_word("text"), X.last_word("text")).collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("x y", "z")]


def test_strip_prompt_prefix_and_names(spark):
    df = spark.createDataFrame([("Hé there", "Hé ", "org/model-3.1-8B", "<s>Hé")], "g string, p string, m string, b string")
    r = df.select(
        X.strip_prompt("g", "p").alias("c"),
        X.run_name("m", F.lit("8bit"), F.lit("40tasks")).alias("run"),
        X.ensure_prefix("g", "<s>").alias("added"),
        X.ensure_prefix("b", "<s>").alias("kept"),
    ).first()
    assert tuple(r) == ("there", "model-3-1-8B-8bit-40tasks", "<s>Hé there", "<s>Hé")


def test_take_first_orders(spark):
    df = frame(spark, ["", "a", "b", "", "c"])
    ok = F.col("text") != ""
    ids = lambda d: [r.row_id for r in d.orderBy("row_id").collect()]
    assert ids(ordering.take_first(df, 3, "select_then_filter", ok)) == [1, 2]
    assert ids(ordering.take_first(df, 2, "filter_then_select", ok)) == [1, 2]
    assert ids(ordering.take_first(df, 0, "filter_then_select", ok)) == [1, 2, 4]
    assert ids(ordering.take_first(df, None, "filter_then_select", ok)) == [1, 2, 4]
    assert ids(ordering.take_first(df, 9, "early_stop", ok)) == [1, 2, 4]
    assert ids(ordering.take_first(df, 2, "early_stop", ok)) == [1, 2]
    assert ids(ordering.take_first(df, 0, "early_stop", ok)) == []
    with pytest.raises(ValueError):
        ordering.take_first(df, 1, "random", ok)


def test_first_hits_grow_the_range(spark):
    # Hits stand far into the keys, so the first ranges hold too few.
    df = spark.range(0, 5000).select((F.col("id") * 3).alias("row_id"))
    ok = F.col("row_id") >= 9000
    got = [r.row_id for r in ordering.take_first(df, 4, "early_stop", ok).orderBy("row_id").collect()]
    assert got == [9000, 9003, 9006, 9009]
    none = ordering.take_first(df, 4, "early_stop", F.col("row_id") < 0)
    assert none.count() == 0


def test_array_scalars(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([9],)], "ids array<int>")
    got = df.select(
        A.token_count("ids"), A.first_tokens("ids", 2), A.pad_ids("ids", 2, 0), A.attention_mask("ids", 2),
        A.mask_prefix("ids", 2), A.mask_all_but_last("ids", 1), A.unmasked(A.mask_prefix("ids", 2)),
    ).collect()
    assert [tuple(r) for r in got] == [
        (3, [5, 6], [5, 6, 7], [1, 1, 1], [-100, -100, 7], [-100, -100, 7], 1),
        (0, [], [0, 0], [0, 0], [], [], 0),
        (1, [9], [9, 0], [1, 0], [-100], [9], 0),
    ]
    whole = df.select(A.mask_all_but_last("ids", 3)).first()[0]
    assert whole == [5, 6, 7]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([3.0],)], "s array<double>")
    assert [r[0] for r in df.select(A.argmax("s")).collect()] == [1, 0]


def test_numbers(spark):
    import numpy as np

    xs = [2.675, 0.125, 0.135, 1.005, -2.345, 89.08499]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(N.round2("x")).collect()] == [float(np.round(x, 2)) for x in xs]
    one = spark.range(1)
    r = one.select(
        N.to_gb(F.lit(2_500_000_000)), N.to_ms(F.lit(0.5)), N.ppl_from_loss(F.lit(1000.0)), N.ppl_from_loss(F.lit(0.0)),
        N.accept_rate(F.lit(3), F.lit(1)), N.accept_rate(F.lit(0), F.lit(0)), N.accept_rate(F.lit(0), F.lit(0), "eps"),
    ).first()
    assert tuple(r) == (2.5, 500.0, float("inf"), 1.0, 0.75, 0.0, 0.0)
    with pytest.raises(ValueError):
        N.accept_rate(F.lit(1), F.lit(1), "none")


def test_row_helpers(spark):
    df = spark.createDataFrame(
        [(0, 0, True, 1.0), (1, 4, False, float("nan")), (2, 8, False, None)],
        "row_idx long, n_tokens int, is_warmup boolean, `system.gpu.0.gpu` double",
    )
    assert rows_of(rows.drop_empty_generations(df), "row_idx") == [(1,), (2,)]
    assert rows_of(rows.drop_warmup(df), "row_idx") == [(1,), (2,)]
    assert rows_of(rows.first_logged(df, 2), "row_idx") == [(0,), (1,)]
    assert rows_of(rows.metric_or_missing(df, "system.gpu.0.gpu")) == [(1.0,)]
    assert rows.metric_or_missing(df, "system.gpu.9.gpu").count() == 0
    status = rows.with_status(df, F.try_divide(F.lit(8.0), "n_tokens"), "rate", "no tokens")
    assert rows_of(status, "row_idx", "status") == [(0, "Error: no tokens"), (1, "ok"), (2, "ok")]
    assert rows.project(df, "row_idx").columns == ["row_idx"]
    both = rows.append_rows(df.select("row_idx"), df.select("n_tokens"))
    assert both.count() == 6 and both.columns == ["row_idx", "n_tokens"]


def test_where_fn(spark):
    df = frame(spark, ["a", "bbb", "cc"])
    assert rows_of(rows.where_fn(df, F.length("text") > 1), "row_id") == [(1,), (2,)]
    assert rows_of(rows.where_fn(df, lambda s: s.str.len() > 2, "text"), "row_id") == [(1,)]


def test_corpus_tokens_and_offsets(spark):
    df = frame(spark, ["a b", "", "c"])
    spread = rows.corpus_tokens(df, "row_id")
    assert rows_of(spread) == [(0, ["a", "b", "\n\n"]), (1, ["\n\n"]), (2, ["c"])]
    assert rows_of(rows.corpus_tokens(df, "row_id", separator=" ")) == [(0, ["a", "b"]), (1, []), (2, ["c"])]
    assert rows_of(rows.corpus_tokens(df, "row_id", bos="<s>"))[0] == (0, ["<s>", "a", "b", "\n\n"])
    assert rows_of(rows.corpus_offsets(df)) == [(0, 0, 3), (1, 3, 1), (2, 4, 1)]
    opened = frame(spark, ["<s> a"])
    assert rows_of(rows.corpus_tokens(opened, "row_id", bos="<s>")) == [(0, ["<s>", "a"])]
