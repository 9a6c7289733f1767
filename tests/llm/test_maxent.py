import math
import zlib
from collections import Counter

import numpy as np

from corpusgauge.llm import maxent
from corpusgauge.llm import queries as Q
from oddities import ascii_lower, documents, frame, sf, split_words  # noqa: F401


def tokens(text):
    return [*split_words(ascii_lower(text or "")), "\n"]


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 60)  # so that most words are joined
    rows = documents()
    train = [r for r in rows if r[0] is None or r[0] % 2 == 0]
    counts = Counter(w for r in train for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    want = [
        (r[0], len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), total,
         round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(r[1])), 6))
        for r in rows
    ]
    got = maxent.fit_and_score(frame(spark), frame(spark, train)).collect()
    have = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert all(r["score"] <= 0 and not math.isnan(r["score"]) for r in got)


def test_held_out_scores_beat_the_base(spark, sf):
    got = Q.op3_maxent_scores(spark, sf).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()
    assert all(got["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 1 for k in got["doc_id"]])


def small_vocabulary():
    words = [b"\n", *[f"w{k}".encode() for k in range(1500)]]
    counts = np.arange(3000, 3000 - len(words), -1)
    return maxent.Vocabulary(words, counts, int(counts.sum()) + 500, len(words) + 40).index()


def test_probabilities_add_up_to_one():
    v = small_vocabulary()
    model = maxent.untrained(v)
    rng = np.random.default_rng(0)
    model.class_rows += rng.normal(0, 0.5, model.class_rows.shape).astype(np.float32)
    model.word_rows += rng.normal(0, 0.5, model.word_rows.shape).astype(np.float32)
    history = [5, 900]
    places = np.array([x for w in range(len(v.words)) for x in [*history, w]] + [*history, -1])
    lengths = np.full(len(v.words) + 1, 3)
    scores = maxent.token_scores(places, lengths, v, model)[2::3]
    rest, distinct = v.rest
    unlisted = rest - v.counts[v.heads :].sum() + 0.5 * (distinct - (len(v.words) - v.heads)) + 0.5  # words not known, and one unseen
    floor = rest + 0.5 * (distinct + 1)
    assert abs(np.exp(scores[:-1]).sum() + np.exp(scores[-1]) * unlisted / floor - 1) < 1e-4


def plain_score(places, v, model):
    """Each token's log probability, one softmax after the other, from the weights."""
    leaves = v.heads + len(v.shared)

    def chance(bias, rows, table, chosen):
        x = bias.astype(np.float64) + sum(table[r].astype(np.float64) for r in rows)
        return x[chosen] - np.log(np.exp(x).sum())

    out = []
    for i, place in enumerate(places):
        before, second = (places[i - k] + 3 if i >= k else 1 for k in (1, 2))
        hashes = [int(maxent.mix(np.array([x % 2**64], np.uint64))[0]) for x in (before * 3, (before << 32) + second * 3 + 1, second * 3 + 2)]
        start, _, steps, first, nodes = next((*r, n) for r, n in zip(maxent.regions(leaves), maxent.first_nodes(leaves)) if r[0] <= place < r[1])
        own, total = int(place) - start, 0.0
        for k in range(steps):
            slot, own = own % maxent.SIZE, own // maxent.SIZE
            node = nodes[k] + own
            used = hashes if k == steps - 1 else hashes[: maxent.DEEP_FEATURES]
            rows = [int(maxent.mix(np.array([(h + node + 1) % 2**64], np.uint64))[0]) % len(model.word_rows) for h in used]
            total += chance(model.word_bias[node], rows, model.word_rows, slot)
        out.append(total + chance(model.class_bias, [h % len(model.class_rows) for h in hashes], model.class_rows, first + own))
    return np.array(out)


def test_scores_equal_softmaxes_computed_one_by_one():
    words = [f"w{k}".encode() for k in range(40_000)]
    v = maxent.Vocabulary(words, np.arange(40_000, 0, -1), 40_000 * 40_001 // 2 + 16, 40_010, shared=np.array([(9, 3), (0, 0), (7, 7)])).index()
    model = maxent.untrained(v)
    rng = np.random.default_rng(1)
    model.class_rows += rng.normal(0, 0.5, model.class_rows.shape).astype(np.float32)
    model.word_rows += rng.normal(0, 0.5, model.word_rows.shape).astype(np.float32)
    places = np.concatenate([[0, 895, 896, 3967, 3968, 39_999, 40_002], rng.integers(0, 40_003, 60)])
    got = maxent.token_scores(places, np.array([len(places)]), v, model)
    assert np.allclose(got, plain_score(places.tolist(), v, model), atol=2e-3)


def test_updates_equal_the_gradient_row_by_row():
    v = small_vocabulary()
    model = maxent.untrained(v)
    rng = np.random.default_rng(2)
    model.class_rows += rng.normal(0, 0.1, model.class_rows.shape).astype(np.float32)
    trainer = maxent.Trainer(model, v)
    rows, target = rng.integers(0, 40, (1, 90)), rng.integers(0, maxent.CLASSES, 90)
    want = model.class_rows.astype(np.float64)
    x = model.class_bias + want[rows[0]]
    grad = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    grad[np.arange(90), target] -= 1
    for r in range(40):
        n = (rows[0] == r).sum()
        if n:
            want[r] -= grad[rows[0] == r].sum(axis=0) * maxent.RATE / np.sqrt(n * (1 + n))
    trainer._update(trainer.model.class_rows, 0, model.class_bias, rows, target)
    assert np.allclose(trainer.model.class_rows, want, atol=1e-5)
    assert trainer.met[0][:40].tolist() == np.bincount(rows[0], minlength=40).tolist()
    big = rng.integers(0, 1 << 18, 5000)
    own, order = maxent.in_order(big)
    assert (order == np.argsort(big, kind="stable")).all() and (own == big[order]).all()


def test_untrained_model_is_the_unigram_model():
    v = small_vocabulary()
    scores = maxent.token_scores(np.array([3, 700, 1200]), np.array([3]), v, maxent.untrained(v))
    share = (v.counts[[3, 700]] + 0.5) / (v.total + 0.5 * maxent.CLASSES * maxent.SIZE)
    assert np.allclose(np.exp(scores[:2]), share, rtol=0.01)


def test_gradient_steps_learn_a_pattern():
    v = small_vocabulary()
    start = maxent.untrained(v)
    trainer = maxent.Trainer(start, v)
    places = np.tile([7, 8, 1100, 9], 2000)
    hashes = maxent.feature_hashes(places, np.array([len(places)]))
    for k in range(0, len(places), 256):
        trainer.step(places[k : k + 256], hashes[:, k : k + 256])
    before = maxent.token_scores(places, np.array([len(places)]), v, start).sum()
    assert maxent.token_scores(places, np.array([len(places)]), v, trainer.model).sum() > before * 0.5
    blocks = list(trainer.changes(start))
    assert blocks and all(len(met) == 4 * maxent.BLOCK for _, met, _ in blocks)


def test_context_chooses_among_rare_words(monkeypatch):
    """Beyond the most frequent words, and among buckets, a history decides which one follows."""
    words = [f"w{k}".encode() for k in range(40_000)]
    shared = np.full((50, 2), (16, 8))
    v = maxent.Vocabulary(words, np.full(len(words), 3), 3 * len(words) + 800, len(words) + 400, shared=shared).index()
    start = maxent.untrained(v)
    for rare in ([5000, 39_000, 20_000, 9000], [40_001, 40_030, 40_010, 40_049]):
        trainer = maxent.Trainer(start, v)
        places = np.tile(rare, 500)
        hashes = maxent.feature_hashes(places, np.array([len(places)]))
        for k in range(0, len(places), 250):
            trainer.step(places[k : k + 250], hashes[:, k : k + 250])
        one = np.array([*rare, rare[0]]), np.array([5])
        swapped = np.array([rare[0], rare[1], rare[2], rare[3], rare[2]]), np.array([5])
        right, wrong = (maxent.token_scores(*x, v, trainer.model)[-1] for x in (one, swapped))
        assert right - wrong > 1 and right > maxent.token_scores(*one, v, start)[-1] + 3


def test_all_words_have_places_and_probabilities_add_up():
    words = [f"w{k}".encode() for k in range(40_000)]
    shared = np.array([(9, 3), (0, 0), (7, 7)])
    v = maxent.Vocabulary(words, np.arange(40_000, 0, -1), 40_000 * 40_001 // 2 + 16, 40_010, shared=shared).index()
    assert v.find(words).tolist() == list(range(40_000)) and v.heads == 40_000
    model = maxent.untrained(v)
    rng = np.random.default_rng(0)
    model.class_rows += rng.normal(0, 0.5, model.class_rows.shape).astype(np.float32)
    model.word_rows += rng.normal(0, 0.5, model.word_rows.shape).astype(np.float32)
    places = np.array([x for w in range(40_003) for x in (5, 900, w)])
    scores = maxent.token_scores(places, np.full(40_003, 3), v, model)[2::3]
    assert abs(np.exp(scores).sum() - 1) < 1e-4
    assert maxent.grown(maxent.WORD_ROWS, 1 << 22) == 4 * maxent.WORD_ROWS


def test_buckets_hold_all_other_words(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 60)
    counts = maxent.count_words(frame(spark)).cache()
    v = maxent.vocabulary(counts)
    assert v.heads <= 61 and len(v.shared) > 1 and tuple(v.shared.sum(axis=0)) == v.rest


def test_empty_tables(spark):
    assert maxent.fit_and_score(frame(spark, []), frame(spark)).count() == 0
    got = maxent.fit_and_score(frame(spark), frame(spark, [])).collect()
    assert len(got) == len(documents())
    assert all(abs(r["base_score"]) + abs(r["score"]) < 1e-6 and r["train_tokens"] == 0 for r in got)
