"""Corpus statistics, selection, cleaning and data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgauge.functions import arrays as A
from corpusgauge.functions import text as X
from corpusgauge.operators import blocks, corpus_stats, ordering, rows, vocabulary
from corpusgauge.plans.common import (
    collection,
    SQL_GAPPY,
    SQL_SAMPLES,
    document_bits,
    document_bounds,
    documents,
    gappy_documents,
    joined,
    samples,
    sql_doc_tokens,
    sql_strip,
    sql_vocab,
    sql_words,
    table,
)
from corpusgauge.session import materialise

BLOCK = 128
W = sql_words("text")
STRIPPED = f"s AS (SELECT doc_id, {sql_strip('text')} AS text FROM documents)"
LENGTHS = f"{STRIPPED}, l AS (SELECT doc_id, text, length(text) AS chars, len({W}) AS tokens FROM s WHERE text <> '')"

QUERIES, ORACLE, query = collection()


@query(
    "corpus_stats",
    f"""WITH {LENGTHS} SELECT (SELECT count(*) FROM documents) AS total, count(*) AS non_empty,
    sum(chars) / count(*) AS mean_chars, sum(tokens) / count(*) AS mean_tokens,
    min(tokens) AS min_tokens, max(tokens) AS max_tokens,
    CAST(quantile_cont(tokens, 0.5) AS DOUBLE) AS median_tokens FROM l""",
)
def corpus_stats_query(spark, sf):
    return corpus_stats.corpus_stats(documents(spark, sf), "doc_id")


@query("corpus_threshold_count", f"WITH {LENGTHS} SELECT count(*) AS n_rows FROM l WHERE tokens >= 128")
def corpus_threshold_count(spark, sf):
    return corpus_stats.count_at_least(documents(spark, sf), 128, "doc_id")


@query(
    "shortest_longest_doc",
    f"""WITH {LENGTHS}
    (SELECT 'shortest' AS which, doc_id, tokens, text FROM l ORDER BY tokens, doc_id LIMIT 1)
    UNION ALL (SELECT 'longest', doc_id, tokens, text FROM l ORDER BY tokens DESC, doc_id LIMIT 1)""",
)
def shortest_longest_doc(spark, sf):
    out = corpus_stats.extreme_rows(documents(spark, sf), "doc_id")
    return out.withColumn("tokens", F.col("tokens").cast("bigint"))


@query("docs_by_length", f"WITH {LENGTHS} SELECT doc_id, tokens FROM l ORDER BY tokens, doc_id")
def docs_by_length(spark, sf):
    lengths = corpus_stats.text_lengths(documents(spark, sf), "doc_id").where(F.col("tokens").isNotNull())
    return ordering.sort_by_length(lengths.select("doc_id", F.col("tokens").cast("bigint").alias("tokens")), "tokens", "doc_id")


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, b AS (SELECT min(tokens)::DOUBLE AS lo, max(tokens)::DOUBLE AS hi FROM l),
    e AS (SELECT i AS bin, lo + i * ((hi - lo) / 50) AS lo,
                 CASE WHEN i = 49 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 50) END AS hi
          FROM b, range(50) t(i))
    SELECT bin, lo, hi, (SELECT count(*) FROM l WHERE tokens >= e.lo AND (tokens < e.hi OR (bin = 49 AND tokens = e.hi))) AS n
    FROM e""",
)
def length_histogram(spark, sf):
    return corpus_stats.length_histogram(documents(spark, sf), 50, "doc_id")


@query("distinct_sizes", "SELECT DISTINCT p_size FROM part ORDER BY p_size")
def distinct_sizes(spark, sf):
    return corpus_stats.distinct_sorted(table(spark, sf, "part"), "p_size")


@query("effective_samples", "SELECT least(500, count(*)) AS samples FROM documents")
def effective_samples(spark, sf):
    return corpus_stats.effective_samples(table(spark, sf, "documents"), 500)


@query(
    "prompts_select_then_filter",
    f"""WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 100), s AS (SELECT doc_id, {sql_strip('text')} AS text FROM f)
    SELECT doc_id, array_to_string({W}[1:128], ' ') AS prompt FROM s WHERE text <> '' AND len({W}) >= 5""",
)
def prompts_select_then_filter(spark, sf):
    chosen = ordering.take_first(
        table(spark, sf, "documents").select("doc_id", "text"),
        100,
        "select_then_filter",
        X.strip("text") != "",
        "doc_id",
    )
    kept = rows.min_words(rows.strip_nonblank(chosen), 5)
    return kept.select("doc_id", X.first_words(X.newline_to_space("text"), 128).alias("prompt"))


@query(
    "prompts_filter_then_select",
    f"""SELECT doc_id, array_to_string({W}[1:128], ' ') AS prompt FROM documents
    WHERE len({W}) >= 128 ORDER BY doc_id LIMIT 500""",
)
def prompts_filter_then_select(spark, sf):
    chosen = ordering.take_first(
        documents(spark, sf), 500, "filter_then_select", X.word_count("text") >= 128, "doc_id"
    )
    return chosen.select("doc_id", X.first_words(X.newline_to_space("text"), 128).alias("prompt"))


@query(
    "prompts_early_stop",
    f"""WITH {STRIPPED} SELECT doc_id, replace(text, chr(10), ' ') AS prompt FROM s
    WHERE len({sql_words("replace(text, chr(10), ' ')")}) >= 128 ORDER BY doc_id LIMIT 200""",
)
def prompts_early_stop(spark, sf):
    cleaned = documents(spark, sf).withColumn("prompt", X.newline_to_space(X.strip("text"))).drop("text")
    return ordering.take_first(cleaned, 200, "early_stop", X.word_count("prompt") >= 128, "doc_id")


@query(
    "prompt_prepare",
    f"""WITH p AS (SELECT doc_id, array_to_string({W}[1:128], ' ') AS prompt FROM documents)
    SELECT doc_id, prompt, CAST(length(prompt) AS BIGINT) AS n_chars FROM p WHERE length(prompt) >= 5""",
)
def prompt_prepare(spark, sf):
    out = rows.prepare_prompts(documents(spark, sf), 128)
    return out.select("doc_id", "prompt", F.length("prompt").cast("bigint").alias("n_chars"))


@query(
    "first_logged",
    f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents WHERE len({W}) >= 128)
    SELECT doc_id, row_idx FROM k WHERE row_idx < 10""",
)
def first_logged(spark, sf):
    kept = documents(spark, sf).where(X.word_count("text") >= 128).select("doc_id")
    return rows.first_logged(ordering.with_row_index(kept, "doc_id", bits=document_bits(spark, sf)), 10)


@query(
    "row_index",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM customer WHERE c_acctbal > 0",
)
def row_index(spark, sf):
    positive = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select("c_custkey")
    return ordering.with_row_index(positive, "c_custkey")


@query(
    "corpus_offsets_space",
    f"""WITH {SQL_GAPPY}, n AS (SELECT doc_id, len({sql_words('text')}) AS n FROM gappy)
    SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS "offset", n FROM n""",
)
def corpus_offsets_space(spark, sf):
    """Texts joined by a space, blank ones among them."""
    return rows.corpus_offsets(gappy_documents(spark, sf), "doc_id", separator=" ", bounds=document_bounds(spark, sf))


@query(
    "corpus_offsets",
    f"""WITH n AS (SELECT doc_id, len({W}) + CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) THEN 1 ELSE 0 END AS n FROM documents)
    SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, n FROM n""",
)
def corpus_offsets(spark, sf):
    return rows.corpus_offsets(documents(spark, sf), "doc_id", bounds=document_bounds(spark, sf))


@query(
    "last_word_split",
    f"""WITH w AS (SELECT item_id, {W} AS w FROM benchmark)
    SELECT item_id, array_to_string(w[1:len(w) - 1], ' ') AS prefix, w[-1] AS target FROM w WHERE len(w) >= 2""",
)
def last_word_split(spark, sf):
    return rows.last_word_split(table(spark, sf, "benchmark")).select("item_id", "prefix", "target")


@query(
    "run_name",
    """SELECT doc_id, replace(list_extract(string_split('hub/' || source || '/v1.' || lang, '/'), -1), '.', '-')
    || '-8bit-' || CAST(n_chars AS VARCHAR) || 'chars' AS run FROM documents""",
)
def run_name(spark, sf):
    docs = table(spark, sf, "documents")
    model = F.concat(F.lit("hub/"), "source", F.lit("/v1."), "lang")
    run = X.run_name(model, F.lit("8bit"), F.concat(F.col("n_chars").cast("string"), F.lit("chars")))
    return docs.select("doc_id", run.alias("run"))


@query("preview", "SELECT doc_id, left(text, 200) || '...' AS preview FROM documents")
def preview(spark, sf):
    return documents(spark, sf).select("doc_id", X.preview("text", 200).alias("preview"))


@query("strip_prompt", f"WITH {SQL_SAMPLES} SELECT sample_id, completion FROM samples")
def strip_prompt(spark, sf):
    made = samples(spark, sf).withColumn("generated", F.concat("prompt", "completion")).drop("completion")
    return rows.strip_prompt(made, "generated", "prompt").select("sample_id", "completion")


@query(
    "ensure_bos",
    """SELECT conv_id, turn, CAST(length(text) + 3 AS BIGINT) AS n_chars, '<s>' || text AS text FROM conversations""",
)
def ensure_bos(spark, sf):
    turns = table(spark, sf, "conversations")
    marked = F.when(F.col("role") == "assistant", F.concat(F.lit("<s>"), "text")).otherwise(F.col("text"))
    out = turns.select("conv_id", "turn", X.ensure_prefix(marked, "<s>").alias("t"))
    return out.select("conv_id", "turn", F.length("t").cast("bigint").alias("n_chars"), F.col("t").alias("text"))


@query("vocab_fit", f"WITH {sql_vocab()} SELECT word, n, CAST(id AS INT) AS id FROM vocab")
def vocab_fit(spark, sf):
    return vocabulary.fit_vocab(documents(spark, sf))


SQL_ENCODED = f"""{sql_vocab()}, {sql_doc_tokens()}, enc AS (
  SELECT doc_id, list(id ORDER BY pos) AS ids FROM tok JOIN vocab ON word = token GROUP BY doc_id)"""


@query(
    "encode_docs",
    f"""WITH {SQL_ENCODED} SELECT d.doc_id, coalesce(array_to_string(ids, ' '), '') AS ids, coalesce(len(ids), 0) AS n
    FROM documents d LEFT JOIN enc USING (doc_id)""",
)
def encode_docs(spark, sf):
    out = encoded_documents(spark, sf)
    return out.select("doc_id", joined("input_ids").alias("ids"), A.token_count("input_ids").cast("bigint").alias("n"))


def encoded_documents(spark, sf):
    return vocabulary.tokenize_own(documents(spark, sf), "doc_id")


@query(
    "encode_other_corpus",
    f"""WITH {sql_vocab()}, t AS (SELECT item_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token
        FROM (SELECT item_id, {W} AS w FROM benchmark))
    SELECT item_id, string_agg(coalesce(id, 0), ' ' ORDER BY pos) AS ids,
           CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown
    FROM t LEFT JOIN vocab ON word = token GROUP BY item_id""",
)
def encode_other_corpus(spark, sf):
    vocab = vocabulary.fit_vocab(documents(spark, sf))
    out = vocabulary.tokenize(table(spark, sf, "benchmark"), vocab, "item_id")
    known = F.array_remove("input_ids", F.lit(vocabulary.UNKNOWN_ID))
    return out.select(
        "item_id", joined("input_ids").alias("ids"), (F.size("input_ids") - F.size(known)).cast("bigint").alias("n_unknown")
    )


SQL_BLOCKS = f"""{SQL_ENCODED}, idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
placed AS (SELECT i // 1000 AS batch, tok.doc_id, tok.pos, vocab.id,
                  row_number() OVER (PARTITION BY i // 1000 ORDER BY tok.doc_id, tok.pos) - 1 AS spot
           FROM tok JOIN vocab ON word = token JOIN idx ON idx.doc_id = tok.doc_id),
blocks AS (SELECT batch, spot // {BLOCK} AS block, list(id ORDER BY spot) AS ids FROM placed
           GROUP BY 1, 2 HAVING count(*) = {BLOCK})"""


@query(
    "group_texts",
    f"""WITH {SQL_BLOCKS} SELECT batch, block, array_to_string(ids, ' ') AS ids, array_to_string(ids, ' ') AS labels FROM blocks""",
)
def group_texts(spark, sf):
    out = document_blocks(spark, sf)
    return out.select("batch", "block", joined("input_ids").alias("ids"), joined("labels").alias("labels"))


@query(
    "group_texts_masked",
    f"""WITH {SQL_BLOCKS} SELECT batch, block, array_to_string(ids, ' ') AS ids,
    array_to_string(list_transform(ids, lambda x: CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END), ' ') AS mask FROM blocks""",
)
def group_texts_masked(spark, sf):
    """A second array, cut with the ids; this mask marks even ids."""
    mask = F.transform("input_ids", lambda x: F.when(x % 2 == 0, 1).otherwise(0))
    encoded = materialise(encoded_documents(spark, sf).withColumn("attention_mask", mask))
    out = blocks.group_texts(encoded, BLOCK, key="doc_id", bits=document_bits(spark, sf), parallel=["attention_mask"])
    return out.select("batch", "block", joined("input_ids").alias("ids"), joined("attention_mask").alias("mask"))


@query(
    "first_blocks",
    f"""WITH {SQL_BLOCKS} SELECT batch, block, array_to_string(ids, ' ') AS ids FROM blocks ORDER BY batch, block LIMIT 300""",
)
def first_blocks(spark, sf):
    """The sample cap on the packed table."""
    out = blocks.first_blocks(materialise(document_blocks(spark, sf)), 300)
    return out.select("batch", "block", joined("input_ids").alias("ids"))


def document_blocks(spark, sf):
    """Blocks of the encoded documents, which are written out once as several steps read them."""
    encoded = materialise(encoded_documents(spark, sf))
    return blocks.group_texts(encoded, BLOCK, key="doc_id", bits=document_bits(spark, sf))


@query(
    "train_validation_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < round_even((SELECT count(*) FROM documents) * 5 / 100.0::DOUBLE, 0)
    THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def train_validation_split(spark, sf):
    keys = table(spark, sf, "documents").select("doc_id")
    train, validation = blocks.split_validation(keys, 5, "doc_id", document_bits(spark, sf))
    return rows.append_rows(
        train.withColumn("split", F.lit("train")), validation.withColumn("split", F.lit("validation"))
    )


SQL_SAMPLE_IDS = f"""{SQL_SAMPLES}, texts AS (SELECT sample_id, prompt || ' ' || completion AS text, len({sql_words('prompt')}) AS p FROM samples),
{sql_vocab('texts')}, t AS (SELECT sample_id, p, generate_subscripts(w, 1) AS i, unnest(w) AS token
  FROM (SELECT sample_id, p, {W} AS w FROM texts)),
enc AS (SELECT sample_id, p, list(CAST(id AS INT) ORDER BY i) AS ids FROM t JOIN vocab ON word = token GROUP BY ALL)"""


def sample_ids(spark, sf):
    """`(sample_id, input_ids, p)`: prompt and completion encoded together, p prompt tokens."""
    pairs = samples(spark, sf).select(
        "sample_id", F.concat_ws(" ", "prompt", "completion").alias("text"), X.word_count("prompt").alias("p")
    )
    ids = vocabulary.tokenize_own(pairs, "sample_id")
    return ids.join(pairs.select("sample_id", "p"), "sample_id")


@query(
    "label_masks",
    f"""WITH {SQL_SAMPLE_IDS} SELECT sample_id,
    array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= p THEN -100 ELSE x END), ' ') AS labels,
    len(ids) - p AS n_labels,
    array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= len(ids) - 16 THEN -100 ELSE x END), ' ') AS last16,
    least(len(ids), 16) AS n_last16 FROM enc""",
)
def label_masks(spark, sf):
    masked = sample_ids(spark, sf).select(
        "sample_id",
        A.mask_prefix("input_ids", F.col("p")).alias("m"),
        A.mask_all_but_last("input_ids", 16).alias("l"),
    )
    return masked.select(
        "sample_id",
        joined("m").alias("labels"),
        A.unmasked("m").cast("bigint").alias("n_labels"),
        joined("l").alias("last16"),
        A.unmasked("l").cast("bigint").alias("n_last16"),
    )


@query(
    "pad_batch",
    f"""WITH {SQL_SAMPLE_IDS}, c AS (SELECT sample_id, ids[1:128] AS ids FROM enc)
    SELECT sample_id, array_to_string(list_transform(range(1, 129), lambda i: coalesce(ids[i], 0)), ' ') AS ids,
    array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ' ') AS mask FROM c""",
)
def pad_batch(spark, sf):
    cut = sample_ids(spark, sf).withColumn("input_ids", A.first_tokens("input_ids", 128))
    out = blocks.pad(cut, 128, 0)
    return out.select("sample_id", joined("input_ids").alias("ids"), joined("attention_mask").alias("mask"))


@query(
    "prompt_batches",
    f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE len({W}) >= 5)
    SELECT i // 8 AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM p GROUP BY 1""",
)
def prompt_batches(spark, sf):
    prompts = rows.min_words(documents(spark, sf), 5).select("doc_id")
    out = blocks.batch_id(prompts, 8, "doc_id", document_bits(spark, sf))
    return out.groupBy("batch").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
