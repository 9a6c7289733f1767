"""The registered queries: names, SQL where there is any, and the contracts' columns."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences
from corpusgauge.llm import queries as Q
from oddities import sf  # noqa: F401

COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_substring_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3_maxent_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op7_chat_prefix_tree": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op8_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op12_mixture_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op13_conversation_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op11_lexical_search": {"item_id", "rank", "doc_id", "score"},
    "op10_ngram_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


def test_one_query_per_operator_and_the_pipeline():
    names = entry.queries().keys()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(Q.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    got = Q.QUERIES[name](spark, sf)
    whole = {c: "Int64" for c, kind in got.dtypes if kind == "bigint"}  # a null leaves the others whole numbers
    assert differences(got.toPandas().astype(whole), connect(sf).execute(Q.ORACLE_SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    got = Q.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(got.columns)
    if name not in ("op7_chat_prefix_tree", "op8_best_fit_packing", "op11_lexical_search", "op12_mixture_packing", "op13_conversation_prefix_trie"):
        assert got.count() == Q.table(spark, sf, "documents").count()


def test_good_documents_are_kept(spark, sf):
    labels = Q.table(spark, sf, "labels").where("quality = 1")
    got = Q.op10_ngram_quality(spark, sf).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] for r in got) >= 0.99 * len(got) > 0
