"""The pipeline on a small table, stage by stage against plain Python."""

import corpus_pipeline as P
import pytest
from corpusgauge.llm import lines
from oddities import documents, frame
from test_repeats import brute
from test_simhash import brute_kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark).write.parquet(f"{path}/documents.parquet")
    leaked = documents()[3][1]
    spark.createDataFrame([(1, leaked), (2, None), (None, leaked)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows)
            prose = [r["doc_id"] for r in before if r["text"] and len(r["text"].split()) > 20 and len(set(r["text"].split())) > 10]
            assert {i for i in prose if i is not None} <= {r["doc_id"] for r in rows}
        elif name == "line_dedup":
            want = [(i, t) for i, t, _, _ in brute(before, lines.line_units, 3)]
            assert sorted([(r["doc_id"], r["text"]) for r in rows], key=repr) == sorted(want, key=repr)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "simhash_near_dedup":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == brute_kept(before)
        elif name == "benchmark_decontamination":
            assert documents()[3][1] in [r["text"] for r in before]
            assert documents()[3][1] not in [r["text"] for r in rows] and len(rows) >= len(before) - 3
        else:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
            assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


def test_short_texts_stay_and_clashing_columns_survive(spark, folder):
    rows = [(1, "A.", "en", "mine", 1), (2, "12 !", "en", "mine", 2), (3, None, "en", "mine", 3), (4, "the of and that with the other", "en", "mine", 4)]
    rows += [(10 + k, r[1], r[2], "mine", k) for k, r in enumerate(documents()[:30])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _lang_score string, _n_lines_removed bigint")
    out = P.identify_language(spark, docs, folder)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert 1 in kept and 4 in kept and 2 not in kept and 3 not in kept
    assert all(r["_lang_score"] == "mine" for r in kept.values())
    cut = {r["doc_id"]: r["_n_lines_removed"] for r in P.dedup_lines(spark, docs, folder).collect()}
    assert cut == {r[0]: r[4] for r in rows}


def test_run_is_the_stages_in_order(spark, folder):
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert P.run(spark, folder).count() > 0


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
