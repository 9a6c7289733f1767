import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import decontaminate as D
from oddities import frame, paragraph
import random

BENCH = "item_id bigint, text string, leaks string"


def brute_tiles(a, b, least):
    """Longest common run of unmarked words first, until none is long enough: its total length."""
    ma, mb, total, sizes = [False] * len(a), [False] * len(b), 0, []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != 0 and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total, sizes
        ma[i : i + n], mb[j : j + n] = [True] * n, [True] * n
        total += n
        sizes.append(n)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=2, max_size=16), st.lists(st.integers(0, 4), max_size=24))
def test_tiles_are_valid_and_start_with_the_longest(a, b):
    found = D.tiles(np.array(a), np.array(b, np.int64), 2)
    _, sizes = brute_tiles(a, b, 2)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
    for k in (0, 1):
        used = [p for t in found for p in range(t[k], t[k] + t[2])]
        assert len(used) == len(set(used))
    assert bool(found) == bool(sizes)
    if sizes:
        assert max(t[2] for t in found) == sizes[0]


def test_tiles_of_texts_cover_what_brute_force_covers():
    rng = random.Random(3)
    for _ in range(40):
        a = [rng.randint(1, 300) for _ in range(40)]
        cuts = sorted(rng.sample(range(40), 3))
        parts = [a[i:j] for i, j in zip([0, *cuts], [*cuts, 40])]
        rng.shuffle(parts)
        b = [w for p in parts for w in [*p, *[rng.randint(400, 900) for _ in range(rng.randint(0, 3))]]]
        known = [w if w <= 300 else 0 for w in b]
        assert sum(t[2] for t in D.tiles(np.array(a), np.array(known), 5)) == brute_tiles(a, known, 5)[0]


def items():
    rng = random.Random(11)
    return [paragraph(rng, lines=3) for _ in range(6)]


def test_leaks_verbatim_reordered_and_partial(spark):
    rng = random.Random(5)
    bench = items()
    moved = bench[1].replace("\n", " ").split(". ")
    rng.shuffle(moved)
    half = " ".join(bench[2].split()[: len(bench[2].split()) // 3])
    texts = [paragraph(rng) + " " + bench[0] + " " + paragraph(rng), paragraph(rng) + " " + ". ".join(moved).upper(), paragraph(rng) + half, paragraph(rng), None, "", bench[3] + bench[0]]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id bigint, text string, Leaks string")
    table = spark.createDataFrame([(k, t, "z") for k, t in enumerate(bench)] + [(None, bench[0], ""), (77, None, ""), (78, "the of", ""), (79, "", "")], BENCH)
    want = {0: [0], 1: [1], 2: [], 3: [], 4: [], 5: [], 6: [0, 3]}
    for size in (16 << 20, 400):  # one block, and several
        got = D.find_leaks(docs, table, block_bytes=size)
        assert got.columns == ["doc_id", "text", "leaks"]
        assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got.collect()} == want
    kept = D.decontaminate(docs, table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == ["doc_id", "text", "Leaks"]


def test_odd_tables(spark):
    table = spark.createDataFrame([(k, t, "") for k, t in enumerate(items())], BENCH)
    assert D.find_leaks(frame(spark), table).where("size(leaks) > 0").count() == 0
    assert D.find_leaks(frame(spark, []), table).count() == 0
    assert D.find_leaks(frame(spark), table.limit(0)).where("size(leaks) > 0").count() == 0


def test_hashes_of_windows_are_those_of_their_words():
    ids = np.array([3, 1, 2, 3, 1, 2, 9], np.int64)
    own = D.Hashes(ids).windows(3)
    assert own[0] == own[3] and len(set(own.tolist())) == 4
    assert np.array_equal(own, D.window_hashes(ids, np.arange(5), 3))
