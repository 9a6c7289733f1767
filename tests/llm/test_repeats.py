import hashlib

import pytest

from corpusgauge.llm import lines, repeats, sentences
from oddities import frame, split_words


def brute(rows, units, width, least=0):
    """Windows in order of (id, place); all but a window's first occurrence are cut."""
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    first = {}
    for r in order:
        for window in windows(units(r["text"] or "")[1], width, least):
            first.setdefault(window, (r["doc_id"] is None, r["doc_id"] or 0))
    out = []
    for r in rows:
        pieces, compared = units(r["text"] or "")
        at = [k for k, c in enumerate(compared) if c]
        seen, lost = set(), set()
        for k, window in enumerate(windows(compared, width, least)):
            if window in seen or first[window] < (r["doc_id"] is None, r["doc_id"] or 0):
                lost |= set(at[k : k + len(window)])
            seen.add(window)
        text = "".join(p for k, p in enumerate(pieces) if k not in lost)
        out.append((r["doc_id"], r["text"] if not lost else text, len(at), len(lost)))
    return sorted(out, key=repr)


def windows(compared, width, least=0):
    own, out = [c for c in compared if c], []
    for k in range(len(own)):
        for n in range(width, len(own) - k + 1):
            if sum(len(split_words(c)) for c in own[k : k + n]) >= least:
                out.append(tuple(own[k : k + n]))
                break
    return out


CASES = [(lines.dedup_lines, lines.line_units, {"width": w}) for w in (1, 3)]
CASES += [(sentences.dedup_sentences, sentences.sentence_units, {"width": w, "least": n}) for w, n in ((1, 0), (3, 0), (2, 5), (2, 16))]


@pytest.mark.parametrize("dedup, units, how", CASES)
def test_against_brute_force(spark, dedup, units, how):
    got = dedup(frame(spark), **how)
    assert got.columns == [*frame(spark).columns, "n_units", "n_removed"]
    rows = [(r["doc_id"], r["text"], r["n_units"], r["n_removed"]) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(frame(spark).collect(), units, **how)


@pytest.mark.parametrize("dedup", [lines.dedup_lines, sentences.dedup_sentences])
def test_empty_table(spark, dedup):
    assert dedup(frame(spark, [])).count() == 0


def test_counts_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x", "y")], "doc_id bigint, text string, N_UNITS string, n_removed string")
    assert [tuple(r) for r in lines.dedup_lines(df).collect()] == [(1, "a\nb\nc", 3, 0)]


def test_overlapping_windows_merge_and_the_first_stays(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\n\n d\ne\ny"), (3, "b\nc\nq")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "x\n\ny", 3: "b\nc\nq"}


def test_units_join_to_the_text():
    for text in ("", "\n", 'He said "a." She: (b!) c。d', "a. b! c?d\n\ne.  f", " x\r\ny. "):
        for units in (lines.line_units, sentences.sentence_units):
            assert "".join(units(text)[0]) == text


def test_window_hashes_tell_order_and_length():
    _, a, _ = repeats.window_hashes(["ab", "c", "d"], 2)
    _, b, _ = repeats.window_hashes(["a", "bc", "d"], 2)
    assert hashlib.sha256(a.tobytes()).digest() != hashlib.sha256(b.tobytes()).digest() and a.shape == (2, 2)


def test_a_passage_inside_other_text_is_found(spark):
    passage = "one two three four five. Six seven eight nine ten eleven. Twelve thirteen fourteen fifteen sixteen seventeen. Done"
    df = spark.createDataFrame([(1, f"Left side {passage} here."), (2, f"Quite another start {passage} and there. The end.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in sentences.dedup_sentences(df, 2, 11).collect()}
    assert got == {1: df.first()["text"], 2: "Quite another start one two three four five. Done and there. The end."}
