import random
from collections import Counter

import numpy as np
import pytest

from corpusgauge.llm import bwt, substrings
from oddities import frame, paragraph


def brute(texts, window):
    times = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if times[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc string, version int, key int")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs, **options).collect()]
    want = [(r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], 200))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_odd_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"][:6000] if r["text"] else r["text"], "d", 1, 2) for r in frame(spark).collect()]
    assert sum(w[2] for w in check(spark, rows)) > 1000


def test_edges_periods_and_near_copies(spark):
    rng = random.Random(2)
    body = paragraph(rng, lines=20)
    data = body.encode()
    texts = [body, body[:199], body[50:249], body[300:500], body[300:501] + "é" * 150, "ab" * 150, "ab" * 100 + "c", "z" * 199, "y" * 201, "é" * 100, "é" * 101]
    for k in range(25):  # one change each, contexts differ on both sides
        at = 40 * k + 17
        texts.append(paragraph(rng, lines=1) + data[:at].decode() + "#" + data[at + 1 :].decode() + str(k))
    for k in range(12):  # a passage in many contexts
        texts.append(paragraph(rng, lines=2) + body[700:950] + paragraph(rng, lines=2))
    rows = [(k, t, "", 0, 0) for k, t in enumerate(texts)]
    want = check(spark, rows)
    assert check(spark, rows, group=3) == want  # crowded anchors
    assert want[7][2] == 0 and want[8][2] == 201 and want[5][2] == 300


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 97])
def test_segments_share_windows_out(monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    text = paragraph(random.Random(4), lines=12).encode()
    seen = []
    for key, first, last, at in substrings.segments(text):
        for k, i, j, a in zip(key.tolist(), first.tolist(), last.tolist(), at.tolist()):
            assert i <= a <= i + 168 and j <= a
            seen += range(i, j + 1)
    assert seen == list(range(len(text) - 199))


def test_repeated_windows_of_one_group_against_brute_force():
    rng = random.Random(9)
    for _ in range(20):
        core = bytes(rng.choices(b"abc", k=260))
        texts, leads = [], []
        for _ in range(rng.randint(2, 12)):
            i, j = rng.randint(0, 40), rng.randint(230, 260)
            left, right = bytes(rng.choices(b"ab", k=rng.randint(0, 20))), bytes(rng.choices(b"ab", k=rng.randint(0, 20)))
            texts.append(left + core[i:j] + right)
            leads.append(len(left) + 100 - i)
        pairs = sorted(set(zip(texts, leads)))
        texts, leads = [t for t, _ in pairs], np.array([n for _, n in pairs])
        weights = np.array([float(rng.randint(1, 2)) for _ in texts])
        times = Counter()
        for t, n, w in zip(texts, leads.tolist(), weights.tolist()):
            for s in range(len(t) - 199):
                times[s - n, t[s : s + 200]] += w
        want = [[s for s in range(len(t) - 199) if times[s - n, t[s : s + 200]] > 1] for t, n in zip(texts, leads.tolist())]
        got = substrings.repeated_windows(texts, leads, weights)
        assert [g.tolist() for g in got] == want


def test_merged_transforms_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        strings = [rng.integers(1, rng.integers(2, 5), rng.integers(0, 12)).tolist() for _ in range(rng.integers(1, 9))]
        cuts = sorted(rng.integers(0, len(strings) + 1, 2).tolist())
        shards = [
            bwt.build(np.array(sum(strings[i:j], []), np.int64), np.array([len(s) for s in strings[i:j]]), i)
            for i, j in zip([0, *cuts], [*cuts, len(strings)]) if j > i
        ]
        depth = int(rng.integers(1, 14))
        merged = bwt.merge(shards, depth)
        found = list(zip(merged.string.tolist(), merged.place.tolist()))
        assert sorted(found) == [(s, p) for s in range(len(strings)) for p in range(len(strings[s]) + 1)]
        tails = [strings[s][p:][:depth] for s, p in found]
        keys = [[*[(1, x) for x in t], *([] if len(t) == depth else [(0, s)])] for t, (s, _) in zip(tails, found)]
        assert keys == sorted(keys)
        for k in range(1, len(found)):
            n = 0
            while n < min(map(len, tails[k - 1 : k + 1])) and tails[k - 1][n] == tails[k][n]:
                n += 1
            assert merged.shared[k] == n
