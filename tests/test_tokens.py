"""Vocabulary, blocks, n-grams and perplexity against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import accuracy, blocks, joins, ngram, perplexity, vocabulary
from conftest import rows_of

WORDS = ["the", "of", "a", "cat", "dog", "sat", "on", "mat"]


def make_texts(n, seed=1, longest=12):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[30, 10, 8, 4, 3, 2, 1, 1], k=rng.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")


def vocab_of(texts):
    counts = Counter(w for t in texts for w in t.split())
    return {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])))}


def test_vocab_and_tokenize(spark):
    texts = make_texts(40)
    df = frame(spark, texts)
    vocab = vocabulary.fit_vocab(df)
    ids = vocab_of(texts)
    assert rows_of(vocab, "word", "id") == sorted(ids.items())
    got = dict(rows_of(vocabulary.tokenize(df, vocab)))
    assert got == {i: [ids[w] for w in t.split()] for i, t in enumerate(texts)}
    other = vocabulary.tokenize(frame(spark, ["cat zebra", ""]), vocab)
    assert rows_of(other) == [(0, [ids["cat"], 0]), (1, [])]


@pytest.mark.parametrize("own", [True, False])
def test_tokenize_on_the_large_path(spark, monkeypatch, own):
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    texts = make_texts(40)
    df = frame(spark, texts)
    ids = vocab_of(texts)
    got = dict(rows_of(vocabulary.tokenize(df, vocabulary.fit_vocab(df), own=own)))
    assert got == {i: [ids[w] for w in t.split()] for i, t in enumerate(texts)}


def test_a_hot_unknown_word_is_balanced(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    vocab = vocabulary.fit_vocab(frame(spark, ["a b", "a"]))
    got = rows_of(vocabulary.tokenize(frame(spark, ["zzz " * 50 + "b", "", "a zzz"]), vocab))
    assert got == [(0, [0] * 50 + [2]), (1, []), (2, [1, 0])]


def test_tokenize_with(spark):
    df = frame(spark, ["a bb", ""])
    out = vocabulary.tokenize_with(df, lambda ts: [[len(w) for w in t.split()] for t in ts])
    assert rows_of(out) == [(0, [1, 2]), (1, [])]


def chunked(arrays, block, batch_rows):
    out = []
    for b in range(0, len(arrays), batch_rows):
        flat = [x for a in arrays[b : b + batch_rows] for x in a]
        out += [(b // batch_rows, i // block, flat[i : i + block]) for i in range(0, len(flat) - block + 1, block)]
    return out


@pytest.mark.parametrize("block,batch_rows", [(4, 10), (16, 10), (8, 1000), (500, 10), (1, 3)])
def test_group_texts(spark, block, batch_rows):
    rng = random.Random(block)
    arrays = [[rng.randint(1, 99) for _ in range(rng.choice([0, 1, 3, 8, 40]))] for _ in range(35)]
    df = spark.createDataFrame([(i * 3, a) for i, a in enumerate(arrays)], "row_id long, input_ids array<int>")
    out = blocks.group_texts(df.repartition(5), block, batch_rows)
    assert rows_of(out, "batch", "block", "input_ids") == chunked(arrays, block, batch_rows)
    assert out.where(~F.col("input_ids").eqNullSafe(F.col("labels"))).count() == 0


def test_exact_multiple_and_short_batch(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5])], "row_id long, input_ids array<int>")
    assert rows_of(blocks.group_texts(df, 4, 2), "batch", "block", "input_ids") == [(0, 0, [1, 2, 3, 4])]


def test_pad_and_batches(spark):
    df = spark.createDataFrame([(5, [1, 2]), (9, [3]), (11, [4])], "row_id long, input_ids array<int>")
    assert rows_of(blocks.pad(df, 3, 0)) == [(5, [1, 2, 0], [1, 1, 0]), (9, [3, 0, 0], [1, 0, 0]), (11, [4, 0, 0], [1, 0, 0])]
    assert rows_of(blocks.batch_id(df, 2), "row_id", "batch") == [(5, 0), (9, 0), (11, 1)]


def test_shift_labels(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [7]), (2, [])], "block long, input_ids array<int>")
    out = blocks.shift_labels(df.withColumn("labels", F.col("input_ids")))
    assert rows_of(out) == [(0, 0, 1, 2), (0, 1, 2, 3)]


@pytest.mark.parametrize("n,pct", [(100, 5), (50, 5), (30, 5), (10, 5), (7, 100), (3, 0), (0, 5)])
def test_split_validation(spark, n, pct):
    df = spark.range(n).select((F.col("id") * 2 + 1).alias("row_id"))
    train, validation = blocks.split_validation(df, pct)
    cut = int(round(n * pct / 100))
    assert rows_of(validation) == [(i * 2 + 1,) for i in range(cut)]
    assert rows_of(train) == [(i * 2 + 1,) for i in range(cut, n)]
    assert blocks.mark_split(df, pct).where("split = 'validation'").count() == cut
    assert blocks.split_validation(df, pct, existing=df)[0].count() == n


def bigrams(seqs, alpha=1.0):
    pairs, ctx, seen = Counter(), Counter(), set()
    for s in seqs:
        seen.update(s)
        for p, t in zip(s, s[1:]):
            pairs[p, t] += 1
            ctx[p] += 1
    v = len(seen)
    return lambda p, t: -math.log((pairs[p, t] + alpha) / (ctx[p] + alpha * v)), pairs


def test_ngram_scores(spark):
    texts = make_texts(30)
    stream = ngram.row_tokens(frame(spark, texts), "row_id")
    model = ngram.fit_ngram(stream)
    nll, pairs = bigrams([t.split() for t in texts])
    assert {(r.prev, r.token): r.n for r in model.collect()} == dict(pairs)
    got = ngram.attach_nll(stream, ngram.seen_nll(model), ["row_id", "pos"])
    for r in got.collect():
        w = texts[r.row_id].split()
        assert w[r.pos] == r.token
        assert r.nll is None if r.pos == 0 else r.nll == pytest.approx(nll(w[r.pos - 1], r.token))


def test_ngram_scores_another_text(spark):
    texts, others = make_texts(30), ["zebra the cat", "cat zebra zebra", "mat", ""]
    model = ngram.fit_ngram(ngram.row_tokens(frame(spark, texts), "row_id"))
    nll, _ = bigrams([t.split() for t in texts], 0.5)
    stream = ngram.row_tokens(frame(spark, others), "row_id")
    got = ngram.score_ngram(stream, model, ["row_id", "pos"], 0.5).collect()
    assert len(got) == 7
    for r in got:
        w = others[r.row_id].split()
        assert r.nll is None if r.pos == 0 else r.nll == pytest.approx(nll(w[r.pos - 1], r.token))


def test_orders_one_and_three(spark):
    texts = make_texts(20)
    stream = ngram.row_tokens(frame(spark, texts), "row_id", order=3)
    flat = [w for t in texts for w in t.split()]
    one = ngram.fit_ngram(stream, [])
    assert {r.token: (r.n, r.ctx_n, r.vocab) for r in one.collect()} == {
        w: (c, len(flat), len(set(flat))) for w, c in Counter(flat).items()
    }
    scored = ngram.score_ngram(stream, one, ["row_id", "pos"])
    assert scored.where("nll is null").count() == 0
    tri = Counter(t for s in texts for t in zip(s.split(), s.split()[1:], s.split()[2:]))
    counts = ngram.count_ngrams(stream, ["prev2", "prev"])
    three = ngram.model_from_counts(counts, ["prev2", "prev"])
    assert {(r.prev2, r.prev, r.token): r.n for r in three.collect()} == dict(tri)
    two = ngram.model_from_counts(ngram.marginal(counts, ["prev"]))
    assert {(r.prev, r.token): r.n for r in two.collect()} == dict(bigrams([t.split() for t in texts])[1])


def best_table(texts):
    pairs = bigrams([t.split() for t in texts])[1]
    best = {}
    for (p, t), n in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0][1])):
        best.setdefault(p, t)
    return best


def test_greedy_completion(spark):
    texts = make_texts(30) + ["x y"]
    best = best_table(texts)
    model = ngram.best_next(ngram.fit_ngram(ngram.row_tokens(frame(spark, texts), "row_id")))
    assert dict(rows_of(model)) == best
    prompts = spark.createDataFrame([(1, "the"), (2, "x"), (3, "zebra"), (4, None)], "id long, last string")
    got = {r.id: (r.completion, r.n_tokens) for r in ngram.greedy_completion(prompts, model, "id", "last", 4).collect()}
    for key, start in ((1, "the"), (2, "x"), (3, "zebra")):
        out, at = [], start
        while len(out) < 4 and at in best:
            at = best[at]
            out.append(at)
        assert got[key] == (" ".join(out), len(out))
    assert got[4] == ("", 0)


def corpus_case(spark, texts, bos=None):
    seq = []
    for i, t in enumerate(texts):
        seq += t.split() + (["\n\n"] if i < len(texts) - 1 else [])
    if bos:
        seq = [bos] + seq
    df = frame(spark, texts).withColumn("row_id", F.col("row_id") * 5)
    stream, n = ngram.corpus_stream(df, "row_id", bos=bos)
    assert n == len(seq)
    return seq, stream


def test_corpus_stream(spark):
    seq, stream = corpus_case(spark, ["a b", "", "", "c", "d e"], "<s>")
    assert rows_of(stream, "pos", "token") == list(enumerate(seq))
    prevs = {r.pos: r.prev for r in stream.collect()}
    assert prevs == {i: (seq[i - 1] if i else None) for i in range(len(seq))}


def losses(n, seed=5):
    rng = random.Random(seed)
    return [None] + [rng.random() * 5 for _ in range(n - 1)]


def left(nll, stride, limit):
    n, total, tokens = len(nll), 0.0, 0
    for i in range(0, n, stride):
        begin, end = max(i + stride - limit, 0), min(i + stride, n)
        scored = [nll[p] for p in range(max(i, begin), end) if p > begin]
        total += (sum(scored) / len(scored) if scored else float("nan")) * (end - i)
        tokens += end - i
    return math.exp(total / tokens) if not math.isnan(total) else float("nan")


def right(nll, stride, limit):
    n, total, tokens, prev = len(nll), 0.0, 0, 0
    for begin in range(0, n, stride):
        end = min(begin + limit, n)
        target = range(max(end - (end - prev), begin), end)
        scored = [nll[p] for p in target if p > begin]
        weight = len(target) - 1
        total += (sum(scored) / len(scored) if scored else float("nan")) * weight
        tokens += weight
        prev = end
        if end == n:
            break
    return math.exp(total / tokens) if tokens and not math.isnan(total) else float("nan")


def overlap(nll, stride, ctx):
    n, total, tokens = len(nll), 0.0, 0
    for begin in range(0, n, stride):
        end = min(begin + ctx, n)
        total += sum(nll[begin:end])
        tokens += end - begin
    return math.exp(total / tokens)


def nll_frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, nll double").repartition(4)


@pytest.mark.parametrize("n", [2, 7, 8, 9, 33, 100])
@pytest.mark.parametrize("stride,limit", [(8, 32), (8, 8), (5, 12), (8, 3)])
def test_strided_perplexities(spark, n, stride, limit):
    values = losses(n)
    df = nll_frame(spark, values)
    a = perplexity.ppl_strided_left(df, stride, limit).first()
    assert a.n_tokens == n
    assert a.ppl == pytest.approx(left(values, stride, limit), nan_ok=True)
    b = perplexity.ppl_strided_right(df, stride, limit).first()
    want = right(values, stride, limit)
    assert b.ppl == pytest.approx(want, nan_ok=True) or (b.ppl is None and math.isnan(want))
    full = [0.5] + values[1:]
    c = perplexity.ppl_overlap(nll_frame(spark, full), stride, limit).first()
    assert c.ppl == pytest.approx(overlap(full, stride, limit))
    per_window = perplexity.overlap_windows(nll_frame(spark, full), stride, limit).collect()
    assert len(per_window) == math.ceil(n / stride)
    assert math.exp(sum(r.nll_sum for r in per_window) / sum(r.trg for r in per_window)) == pytest.approx(c.ppl)


def test_single_conditional_continuation(spark):
    values = losses(20)
    df = nll_frame(spark, values)
    one = perplexity.ppl_single(df).first()
    assert (one.n_tokens, one.ppl) == (19, pytest.approx(math.exp(sum(values[1:]) / 19)))
    rows = [(1, p, v, 2) for p, v in enumerate([None, 1.0, 2.0, 4.0])] + [(2, p, v, 1) for p, v in enumerate([None, 3.0])]
    table = spark.createDataFrame(rows, "sample_id long, pos long, nll double, prompt_len int")
    samples = spark.range(4)
    want = math.exp(3.0) + math.exp(3.0)
    assert perplexity.ppl_conditional(table, samples).first().ppl == pytest.approx(want / 4)
    assert perplexity.ppl_conditional(table, samples, keep_skipped=False).first().ppl == pytest.approx(want / 2)
    cont = dict((r.sample_id, r.ppl) for r in perplexity.ppl_continuation(table, "sample_id").collect())
    assert cont[1] == pytest.approx(math.exp(7 / 3)) and cont[2] == pytest.approx(math.exp(3.0))


@pytest.mark.parametrize("stride,limit", [(8, 32), (8, 8), (5, 12), (8, 3), (1000, 2000)])
def test_bigram_sums_equal_windows_over_positions(spark, stride, limit):
    texts = make_texts(30)
    df = frame(spark, texts)
    stream, n = ngram.corpus_stream(df, "row_id")
    scored = ngram.seen_nll(ngram.fit_ngram(ngram.corpus_bag(df, "row_id")))
    nll = ngram.attach_nll(stream, scored, ["pos"]).select("pos", "nll")
    for weight, by_window in (
        (perplexity.weight_left(n, stride, limit), perplexity.ppl_strided_left),
        (perplexity.weight_right(n, stride, limit), perplexity.ppl_strided_right),
    ):
        got = perplexity.ppl_bigrams(perplexity.weigh_bigrams(stream, weight)).first()
        want = by_window(nll, stride, limit).first()
        assert (got.n_tokens, got.ppl) == (want.n_tokens, pytest.approx(want.ppl)) or math.isnan(want.ppl) and math.isnan(got.ppl)


def test_window_without_labels_gives_nan(spark):
    # 9 tokens in windows of 8 with no carried context: the last window scores nothing.
    df = frame(spark, ["a b c d e f g h i"])
    stream, n = ngram.corpus_stream(df, "row_id")
    types = perplexity.weigh_bigrams(stream, perplexity.weight_left(n, 8, 8))
    assert math.isnan(perplexity.ppl_bigrams(types).first().ppl)


@pytest.mark.parametrize("stride,ctx", [(4, 8), (8, 8), (8, 3)])
def test_own_token_sums_equal_overlaps(spark, stride, ctx):
    texts = make_texts(20)
    seq, stream = corpus_case(spark, texts, "<s>")
    nll, _ = bigrams([seq])
    want = overlap([nll(t, t) for t in seq], stride, ctx)
    types = perplexity.weigh_bigrams(stream, perplexity.weight_overlap(stride, ctx))
    assert perplexity.ppl_own_token(types).first().ppl == pytest.approx(want)


def test_single_sums(spark):
    df = frame(spark, make_texts(30))
    scored = ngram.seen_nll(ngram.fit_ngram(ngram.corpus_bag(df, "row_id")))
    stream, _ = ngram.corpus_stream(df, "row_id")
    by_pos = perplexity.ppl_single(ngram.attach_nll(stream, scored, ["pos"])).first()
    weight = F.when(F.col("prev").isNotNull(), 1.0).otherwise(0.0)
    by_type = perplexity.ppl_bigrams(perplexity.weigh_bigrams(ngram.corpus_bag(df, "row_id"), weight)).first()
    assert by_pos.n_tokens == by_type.n_tokens
    assert by_pos.ppl == pytest.approx(by_type.ppl)


def test_accuracies(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (4, 4), (5, None)], "pred int, label int")
    assert tuple(accuracy.token_accuracy(df).first()) == (3, 2 / 3)
    weighted = spark.createDataFrame([(1, 1, 5), (2, 3, 5)], "pred int, label int, n int")
    assert tuple(accuracy.token_accuracy(weighted, weight="n").first()) == (10, 0.5)
    made = spark.createDataFrame([("cat", " cat sat"), ("dog", ""), ("a", "b"), ("x", None)], "target string, generated string")
    assert tuple(accuracy.last_word_accuracy(made).first()) == (4, 1, 0.25)
    assert tuple(accuracy.last_word_accuracy(made.limit(0)).first()) == (0, 0, 0.0)


def test_pass_at_k(spark):
    cases = {"none": (10, 0), "some": (10, 3), "all": (4, 4), "most": (6, 5), "one": (1, 1)}
    data = [(t, i < c) for t, (n, c) in cases.items() for i in range(n)]
    df = spark.createDataFrame(data, "task_id string, passed boolean")
    got = {r.task_id: r for r in accuracy.task_pass_at_k(df, (1, 5, "n")).collect()}

    def want(n, c, k):
        if n - c < k:
            return 1.0 if c else 0.0
        return 1 - math.comb(n - c, k) / math.comb(n, k)

    for t, (n, c) in cases.items():
        for k in (1, 5):
            assert got[t][f"pass_at_{k}"] == pytest.approx(want(n, c, k))
        assert got[t]["pass_at_n"] == (1.0 if c else 0.0)
    mean = accuracy.pass_at_k(df, (1,)).first()
    assert mean.pass_at_1 == pytest.approx(sum(want(n, c, 1) for n, c in cases.values()) / 5)
