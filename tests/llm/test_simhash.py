import numpy as np
import pytest
import xxhash

from corpusgauge.llm import simhash
from corpusgauge.llm.graph import components
from corpusgauge.session import materialise
from oddities import ascii_lower, frame, split_words


def brute_fingerprint(text, width=4):
    ws = split_words(ascii_lower(text or ""))
    runs = [ws[i : i + width] for i in range(max(1, len(ws) - width + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=4):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_against_brute_force(spark):
    rows = frame(spark).collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    root = brute_groups(set(prints))
    first = {}
    for r, f in zip(rows, prints):
        if r["doc_id"] is not None:
            first[root[f]] = min(first.get(root[f], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f, first.get(root[f])) for r, f in zip(rows, prints)), key=repr)
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("heavy", [4096, 3])
@pytest.mark.parametrize("radius", [2, 4, 7])
def test_links_connect_what_brute_force_connects(spark, heavy, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 3), replace=False)) for s in seeds for _ in range(12)]
    prints = sorted({0, *near})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    distinct = materialise(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    links = simhash.find_links(distinct, simhash.plan(distinct, radius), radius, heavy)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_groups(set(prints), radius)
    back = dict(zip(prints, signed))
    classes = {}
    for f in prints:
        classes.setdefault(want[f], set()).add(found.get(back[f], back[f]))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_long_runs_give_a_forest_with_the_same_groups():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 14, 900, dtype=np.uint64))
    a, b = simhash.linked_runs(np.zeros(len(fps), np.uint64), fps, 2)
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) <= 2).all()


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 9], [0, 1, 20], [0, 4, 6]]
    best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in np.ndindex(3, 3, 3) for ts in [tuple(x - 1 for x in ts)] if sum(ts) == 0)
    cost, chosen = simhash.allocate(costs, 0)
    assert cost == best and sum(chosen) == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(5, 5), (None, 3), (1000, 999), (999, 1000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 400)} | {999: 999, 1000: 999}


def test_empty_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_kept(rows):
    """Keys (id is null, id) of the first row of each group."""
    prints = [brute_fingerprint(r["text"]) for r in rows]
    root, first = brute_groups(set(prints)), {}
    for r, f in zip(rows, prints):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        first[root[f]] = min(first.get(root[f], key), key)
    return sorted(first.values())


def test_one_of_each_group_stays(spark):
    got = simhash.keep_one(frame(spark))
    assert got.columns == frame(spark).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == brute_kept(frame(spark).collect())
