import math
import re
from collections import Counter

import pytest

from corpusgauge.llm import lexical
from oddities import ascii_lower, documents, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, score bigint, term string, at int, block int"


def terms(text):
    return TERM.findall(ascii_lower(text or ""))


def brute(docs, items, best=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, tf in held:
            m = 25 + 75 * sum(tf.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scored)[:best], 1)]
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in items], ITEMS)


def odd_items():
    texts = [r[1] for r in documents()]
    return [
        (1, texts[3]), (2, texts[7][:200]), (2, texts[7][:200]), (5, texts[7][50:90]), (7, None), (8, ""), (9, " .,!\n"),
        (10, "THE the Those"), (11, "nowhere-to-be-found"), (12, "x"), (13, "é x" * 3), (None, "the of and"), (14, "same line same line same"),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, block_bytes):
    items, rows = odd_items(), documents()
    got = lexical.search(frame(spark, rows).repartition(5), items_frame(spark, items), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([r[:2] for r in rows], items)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ties_rank_by_id(spark):
    rows = [(k, "alpha beta" if k % 2 else "gamma") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = lexical.search(docs, items_frame(spark, [(0, "alpha")])).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(k + 1, 2 * k + 1) for k in range(10)]
    assert len({r["score"] for r in got}) == 1


def test_fewer_than_ten_and_more(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c")], "doc_id bigint, text string")
    items = items_frame(spark, [(0, "a"), (1, "c d")])
    assert lexical.search(docs, items).groupBy("item_id").count().orderBy("item_id").collect() == [(0, 2), (1, 1)]
    assert lexical.search(docs, items, best=1).count() == 2


def test_empty_tables(spark):
    docs, items = frame(spark, []), items_frame(spark, [])
    for d, i in ((docs, items), (docs, items_frame(spark, odd_items())), (frame(spark), items)):
        assert lexical.search(d, i).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id bigint, text string"), items_frame(spark, odd_items())).collect() == []


def test_matches_are_whole_terms():
    known = lexical.automaton(["ab", "abc", "b", "é"])
    n, found = lexical.scan("Ab,ABC b-b bé É é xb b1 ab".encode(), known)
    assert n == 10 and found == {0: 2, 1: 1, 2: 2, 3: 1}
