import math
from collections import Counter

from corpusgauge.llm import quality
from oddities import documents, frame, split_words


def brute(text):
    ws = split_words(text)
    n = len(ws)
    seen = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    covered = {k for i in range(n - 7) if seen[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    repeats = len(covered)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rule_counts(spark):
    rows = [(k, r[1]) for k, r in enumerate(documents())]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1,), (None,), (1,)], "doc_id bigint"))
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert found == {k: brute(t) for k, t in rows}


def test_scores_against_brute_force(spark):
    rows = [(k, r[1]) for k, r in enumerate(documents())]
    good = set(range(0, 40, 3))
    n = 512
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    grams = {r["doc_id"]: r["b"] for r in df.select("doc_id", quality.let(quality.word_hashes(quality.F.coalesce("text", quality.F.lit(""))), lambda h: quality.buckets(h, quality.paired(h), n)).alias("b")).collect()}
    assert all(len(grams[k]) == max(2 * len(split_words(t)) - 1, 0) for k, t in rows)
    raw, target = Counter(), Counter()
    for k, b in grams.items():
        raw.update(b)
        if k in good:
            target.update(b)
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]
    got = quality.judge(df, spark.createDataFrame([(k,) for k in good], "doc_id bigint"), n=n).collect()
    for r in got:
        own = grams[r["doc_id"]]
        want = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert abs(r["score"] - want) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_clashing_columns_empty_tables_and_no_python(spark):
    trusted = spark.createDataFrame([(0,), (3,)], "doc_id bigint")
    got = quality.judge(frame(spark), trusted)
    assert got.count() == len(documents())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.judge(frame(spark, []), trusted).count() == 0
    assert quality.judge(frame(spark), trusted.limit(0)).where("kept").count() >= 0
