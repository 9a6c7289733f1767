import numpy as np
import pytest

from corpusgauge.llm import langid
from corpusgauge.llm import queries as Q
from oddities import documents, frame, sf  # noqa: F401


@pytest.fixture(scope="module")
def filters(spark):
    return langid.fit(frame(spark))


def test_held_out_accuracy(spark, sf):
    got = Q.op1_language_id(spark, sf).join(Q.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark, filters):
    got = langid.predict(frame(spark), filters).collect()
    assert len(got) == len(documents())
    for r in got:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in filters.langs
    assert langid.predict(frame(spark), filters).columns == [*[c for c in frame(spark).columns if c != "score"], "lang_pred", "score"]
    lettered = [r for r in got if r["text"] and len(r["text"]) > 200 and r["lang"] in ("de", "fr")]
    assert sum(r["lang"] == r["lang_pred"] for r in lettered) >= 0.9 * len(lettered)


def test_nothing_learned_and_empty_tables(spark, filters):
    none = langid.fit(frame(spark, []))
    assert {r["lang_pred"] for r in langid.predict(frame(spark), none).collect()} == {"und"}
    assert langid.predict(frame(spark, []), filters).count() == 0


def test_popcounts_against_one_filter_per_language():
    rng = np.random.default_rng(0)
    own = langid.empty_filters(["a", "b", *[f"l{k}" for k in range(70)]], 1 << 12)
    sets = {k: np.unique(rng.integers(0, 2**62, 300, dtype=np.uint64)) for k in (0, 1, 65, 71)}
    for k, grams in sets.items():
        own.add(grams, k)
    for k, grams in sets.items():
        hit = own.containing(grams)
        assert ((hit[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    probe = rng.integers(0, 2**62, 4000, dtype=np.uint64)
    hit = own.containing(probe)
    for k in sets:
        bits = np.zeros(1 << 12, bool)
        for p in range(langid.PROBES):
            bits[own.slots(sets[k], p)] = True
        alone = np.ones(len(probe), bool)
        for p in range(langid.PROBES):
            alone &= bits[own.slots(probe, p)]
        assert (((hit[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool) == alone).all()
        # foreign n-grams let through are taken off again
        counts = np.zeros((1, 72))
        counts[0, k] = alone.sum()
        assert abs(own.corrected(counts, np.array([4000.0]))[0, k]) < 60


def test_long_texts_lose_no_ngram(monkeypatch):
    text = "Das ist ein Haus, und dies ein langeswortohneleerzeichen " * 9
    whole = np.sort(np.concatenate(list(langid.text_grams(text))))
    monkeypatch.setattr(langid, "SLICE", 23)
    assert np.array_equal(np.sort(np.concatenate(list(langid.text_grams(text)))), whole)


def plain_grams(text):
    """Four characters at a time of the lower-case letters, all else one blank, blanks at the ends only."""
    told = " "
    for c in [*(text or ""), " "]:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or told[-1] != " ":
            told += c
    out = []
    for k in range(len(told) - 3):
        gram = told[k : k + 4]
        if " " not in gram[1:3]:
            number = 0
            for c in gram:
                number = (number * 0x9E3779B97F4A7C15 % 2**64) ^ ord(c)
            out.append(number)
    return out


def plain_predictions(rows, slots):
    """`(language, score)` per text, by one filter after the other."""
    counts = {}
    for text, lang in rows:
        if lang is not None and text is not None:
            own = counts.setdefault(lang, {})
            for g in plain_grams(text):
                own[g] = own.get(g, 0) + 1
    rates = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    most = {}
    for own in rates.values():
        for g, r in own.items():
            most[g] = max(most.get(g, 0), r)

    def places(g):
        return [int(langid.mix(np.array([(g + p * 0x632BE59BD9B4E019) % 2**64], np.uint64))[0]) % slots for p in range(langid.PROBES)]

    filters = {lang: {s for g, r in own.items() if r >= langid.MIN_RATE and r >= langid.MIN_SHARE * most[g] for s in places(g)} for lang, own in rates.items()}
    out = []
    for text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        found = [places(g) for g in plain_grams(text)]
        best = []
        for lang in sorted(filters):
            false = (len(filters[lang]) / slots) ** langid.PROBES
            hits = sum(all(s in filters[lang] for s in p) for p in found)
            best.append((max(0.0, (hits - len(found) * false) / (1 - false)), lang))
        top = max(b for b, _ in best)
        out.append((next(lang for b, lang in best if b == top), min(1.0, top / max(len(found), 1))))
    return out


def test_predictions_equal_plain_ones(spark):
    rows = documents()
    got = langid.predict(frame(spark).select("text", "lang"), langid.fit(frame(spark), slots=1 << 13)).collect()
    want = plain_predictions([(r[1], r[2]) for r in rows], 1 << 13)
    told = {r[1]: w for r, w in zip(rows, want)}
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == told[r["text"]][0] and abs(r["score"] - told[r["text"]][1]) < 1e-9
