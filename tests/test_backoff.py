"""The back-off model and the two-level and outlier-aware quantisation against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusgauge.operators import backoff, ngram, perplexity, quantize

WORDS = "a b c d e".split()


def corpus(seed=5, n=40):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, weights=[8, 4, 2, 1, 1], k=rng.randint(1, 12)))) for k in range(n)]


def plain_model(rows, order):
    """p(context, token) by the definition; a context is a tuple, the nearest word first."""
    grams = Counter()
    vocab = set()
    for _, text in rows:
        words = text.split()
        vocab.update(words)
        for i in range(order - 1, len(words)):
            grams[tuple(words[i - k] for k in range(1, order)), words[i]] += 1
    levels = []
    while True:
        n1, n2 = (sum(v == k for v in grams.values()) for k in (1, 2))
        taken = min(max(n1 / (n1 + 2 * n2) if n1 else 0.0, 0.1), 0.9)
        total, kinds = defaultdict(int), defaultdict(int)
        for (context, _), n in grams.items():
            total[context] += n
            kinds[context] += 1
        levels.append((dict(grams), total, kinds, taken))
        if not next(iter(grams))[0]:
            break
        grams = Counter((context[:-1], token) for context, token in grams)

    def p(context, token, level=0):
        below = p(context[:-1], token, level + 1) if context else 1 / (len(vocab) + 1)
        grams, total, kinds, taken = levels[level]
        if context not in total:
            return below
        return max(grams.get((context, token), 0) - taken, 0) / total[context] + taken * kinds[context] / total[context] * below

    return p


@pytest.mark.parametrize("context", [("prev",), ("prev", "prev2"), ()])
def test_probabilities_equal_the_definition_and_add_up_to_one(spark, context):
    rows = corpus()
    stream = ngram.row_tokens(spark.createDataFrame(rows, "id bigint, text string"), "id", order=3)
    model = backoff.fit_backoff(ngram.count_ngrams(stream, context), context)
    asked = [(*c, t) for c in ([(x,) for x in [*WORDS, "new"]] if len(context) == 1 else [(x, y) for x in [*WORDS, "new"] for y in WORDS] if context else [()]) for t in [*WORDS, "other"]]
    types = spark.createDataFrame(asked, ", ".join(f"{c} string" for c in (*context, "token")))
    got = {tuple(r)[:-1]: r["p"] for r in backoff.probabilities(types, model).collect()}
    p = plain_model(rows, len(context) + 1)
    sums = defaultdict(float)
    for key, value in got.items():
        assert abs(value - p(key[:-1], key[-1])) < 1e-12 and value > 0
        sums[key[:-1]] += value
    assert len(got) == len(asked) and all(abs(s - 1) < 1e-12 for s in sums.values())


def test_losses_feed_the_perplexities(spark):
    rows, other = corpus(), [(0, "a b new a"), (1, "c"), (2, "e e d b")]
    made = spark.createDataFrame(rows, "id bigint, text string")
    model = backoff.fit_backoff(ngram.count_ngrams(ngram.row_tokens(made, "id")))
    stream = ngram.row_tokens(spark.createDataFrame(other, "id bigint, text string"), "id")
    scored = backoff.score_backoff(stream, model, ["id", "pos"])
    p = plain_model(rows, 2)
    want = [-math.log(p((a,), b)) for _, t in other for a, b in zip(t.split(), t.split()[1:])]
    got = {(r["id"], r["pos"]): r["nll"] for r in scored.collect()}
    assert len(got) == 9 and got[1, 0] is None and sum(v is None for v in got.values()) == 3
    one = perplexity.ppl_single(scored).first()
    assert one["n_tokens"] == 6 and abs(one["ppl"] - math.exp(sum(want) / 6)) < 1e-9


def test_an_empty_corpus(spark):
    counts = ngram.count_ngrams(ngram.row_tokens(spark.createDataFrame([], "id bigint, text string"), "id"))
    model = backoff.fit_backoff(counts)
    types = spark.createDataFrame([("a", "b")], "prev string, token string")
    assert backoff.probabilities(types, model).first()["p"] == 1.0


def vectors(seed=2, n=600, size=100):
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 1, (n, size)).astype(np.float32)
    out[:, 7] *= 20
    out[3, 50] = -9.0
    return [(k, [float(x) for x in v]) for k, v in enumerate(out)]


def test_outlier_columns_are_kept(spark):
    rows = [*vectors(), (1000, [0.5, -0.25]), (1001, []), (1002, None), (1003, [0.0] * 100)]
    got = {r["id"]: r for r in quantize.quantize_outliers(spark.createDataFrame(rows, "id bigint, v array<float>"), "v").collect()}
    for k, v in rows:
        r = got[k]
        if v is None:
            assert r["codes"] is None
            continue
        x = np.array(v)
        kept = np.array([i in (7, 50) for i in range(len(x))], bool)
        assert r["kept"] == x[kept].tolist() and [c is None for c in r["codes"]] == kept.tolist()
        if not len(x):
            assert r["mse"] is None
            continue
        scale = np.abs(x[~kept]).max()
        codes = np.rint(x * 127 / scale) if scale else np.zeros(len(x))
        assert [c for c in r["codes"] if c is not None] == codes[~kept].astype(int).tolist()
        back = np.where(kept, x, codes * scale / 127)
        assert np.allclose(r["restored"], back) and abs(r["mse"] - ((x - back) ** 2).mean()) < 1e-12
        assert abs(r["outlier_share"] - kept.mean()) < 1e-12 and abs(r["ratio"] - (len(x) + 3 * kept.sum() + 4) / (4 * len(x))) < 1e-12
    plain = quantize.quantize(spark.createDataFrame(rows[:50], "id bigint, v array<float>"), "v").collect()
    # The large values no longer stretch the scale.
    assert sum(got[r["id"]]["mse"] for r in plain) < sum(r["mse"] for r in plain) / 20


def test_scales_are_quantised_in_blocks_that_cross_rows(spark):
    rows = [*vectors(n=290), (1000, [0.5, -0.25]), (1001, []), (1003, [0.0] * 100)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(5)
    got = {r["id"]: r for r in quantize.quantize_twice(df, "id", "v").collect()}
    once = {r["id"]: r for r in quantize.quantize(df, "v", 4).collect()}
    scales = [(k, b, np.abs(np.array(v[b * 64 : b * 64 + 64])).max()) for k, v in rows for b in range(-(-len(v) // 64))]
    mean = np.mean([s for *_, s in scales])
    back, codes = {}, {}
    for at in range(0, len(scales), 256):
        part = scales[at : at + 256]
        top = max(abs(s - mean) for *_, s in part)
        for k, b, s in part:
            codes[k, b] = int(np.rint((s - mean) * 127 / top))
            back[k, b] = codes[k, b] * top / 127 + mean
    levels = np.array(quantize.NF4_LEVELS)
    for k, v in rows:
        r, n = got[k], -(-len(v) // 64)
        assert r["codes2"] == [codes[k, b] for b in range(n)]
        if not v:
            assert r["mse"] is None
            continue
        assert r["codes"] == once[k]["codes"]
        want = [levels[c] * back[k, i // 64] for i, c in enumerate(r["codes"])]
        assert np.allclose(r["restored"], want)
        assert abs(r["ratio"] - (-(-len(v) // 2) + n * (1 + 4 / 256)) / (4 * len(v))) < 1e-12
    assert got[0]["ratio"] < once[0]["ratio"]


def test_the_models_own_bigrams_need_no_join_with_themselves(spark):
    rows = corpus()
    stream = ngram.row_tokens(spark.createDataFrame(rows, "id bigint, text string"), "id", order=2)
    model = backoff.fit_backoff(ngram.count_ngrams(stream))
    found = backoff.own_probabilities(model)
    asked = backoff.probabilities(model.levels[-1].grams, model)
    assert {tuple(r)[:2]: r["p"] for r in found.drop("n").collect()} == pytest.approx({tuple(r)[:2]: r["p"] for r in asked.collect()})
    assert found.select("prev", "token", "n").exceptAll(model.levels[-1].grams).count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_counts_score_and_complete_as_the_whole_model_does(spark):
    counts = ngram.count_ngrams(ngram.row_tokens(spark.createDataFrame(corpus(), "id bigint, text string"), "id"))
    other = spark.createDataFrame([(1, "a b new a"), (2, "e"), (3, None), (4, "new b b")], "id bigint, text string")
    stream = ngram.row_tokens(other, "id")
    old = ngram.score_ngram(stream, ngram.model_from_counts(counts), ["id", "pos"], 0.5)
    new = ngram.score_counted(stream, counts, ["id", "pos"], 0.5)
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    prompts = spark.createDataFrame([(1, "a"), (2, "new"), (3, None), (4, "a"), (5, "d")], "id bigint, last string")
    old = ngram.greedy_completion(prompts, ngram.best_next(counts), "id", "last", 3)
    new = ngram.greedy_counted(prompts, counts, "id", "last", 3)
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
