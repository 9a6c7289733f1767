"""The registered queries of this subpackage, one per operator, and their SQL.

Each reads its whole table, applies an operator with production parameters and derives the digest
columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import chat, decontaminate, langid, lexical, lines, maxent, mixture, packing, quality, sentences, simhash, substrings, trie
from corpusgauge.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Text of a public tokenizer file; the driver reads it once."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in as few 4096-token sequences as the search finds; one row per piece."""
    return packing.pack_documents(table(spark, sf, "documents"), public_vocabulary())


@query
def op4_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of the labelled ones."""
    held_out = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    docs = table(spark, sf, "documents")
    filters = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _cut_digest(found: DataFrame, units: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id", F.col("n_units").alias(units), "n_removed",
        F.length(text).cast("bigint").alias("n_kept_chars"), F.sha2(text, 256).alias("kept_sha256"),
    )


def _cut_sql(pieces: str, blanks: str, units: str, width: int, least: int = 0) -> str:
    """SQL of the repeated-run cut: pieces of each text, windows over those that are not blank.

    A unit has a word or more, so a window of `least` words ends within as many units.
    """
    return f"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, {pieces} AS p FROM documents),
piece AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS body FROM doc),
unit AS (SELECT doc_id, i, trim(body, {blanks}) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS spot
  FROM piece WHERE trim(body, {blanks}) <> ''),
told AS (SELECT doc_id, spot, sum(len(regexp_extract_all(c, '[^ \t-\r]+'))) OVER (PARTITION BY doc_id ORDER BY spot) AS said FROM unit),
span AS (SELECT a.doc_id, a.spot, min(b.spot) AS stop FROM told a LEFT JOIN told z ON z.doc_id = a.doc_id AND z.spot = a.spot - 1
  JOIN told b ON b.doc_id = a.doc_id AND b.spot BETWEEN a.spot + {width - 1} AND a.spot + {max(width, least) - 1}
    AND b.said - coalesce(z.said, 0) >= {least} GROUP BY 1, 2),
win AS (SELECT s.doc_id, s.spot, stop, string_agg(c, chr(0) ORDER BY u.spot) AS k
  FROM span s JOIN unit u ON u.doc_id = s.doc_id AND u.spot BETWEEN s.spot AND stop GROUP BY 1, 2, 3),
ranked AS (SELECT doc_id, spot, stop, row_number() OVER (PARTITION BY k ORDER BY doc_id, spot) AS r FROM win),
gone AS (SELECT DISTINCT u.doc_id, u.i FROM unit u JOIN ranked r ON r.doc_id = u.doc_id
  AND u.spot BETWEEN r.spot AND r.stop WHERE r.r > 1),
n AS (SELECT doc_id, count(*) AS n FROM unit GROUP BY 1),
rest AS (SELECT doc_id, coalesce(string_agg(body, '' ORDER BY i) FILTER (g IS NULL), '') AS t, count(g) AS lost
  FROM (SELECT p.doc_id, p.i, p.body, g.i AS g FROM piece p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i)
  GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS {units}, coalesce(lost, 0) AS n_removed, length(coalesce(t, '')) AS n_kept_chars,
  sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)"""


@query
def op6_sentence_span_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the sentences of repeated spans of two sentences and sixteen words or more."""
    return _cut_digest(sentences.dedup_sentences(table(spark, sf, "documents").select("doc_id", "text")), "n_sentences")


ORACLE_SQL["op6_sentence_span_dedup"] = _cut_sql(
    r"""string_split(regexp_replace(coalesce(text, ''), '([.!?]["''”’»)\]]*[ \t\r\n]|[。！？।؟]|\n)', '\1' || chr(30), 'g'), chr(30))""",
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", "n_sentences", sentences.WIDTH, sentences.WORDS,
)


@query
def op9_three_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows."""
    return _cut_digest(lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text")), "n_lines")


ORACLE_SQL["op9_three_line_dedup"] = _cut_sql(
    "string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(30)), chr(30))",
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", "n_lines", lines.WIDTH,
)


@query
def op10_ngram_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Rule counts and verdict of every document; documents labelled good are the trusted target."""
    good = table(spark, sf, "labels").where(F.col("quality") == 1)
    found = quality.judge(table(spark, sf, "documents"), good)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("score", 9).alias("score"),
    )


@query
def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each document leaks a benchmark item; the item it covers most of, and how many it leaks."""
    found = decontaminate.find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    share = F.transform("leaks", lambda x: F.struct((x["n_covered"] / x["n_words"]).alias("share"), (-x["item_id"]).alias("item")))
    best = F.array_max(share)
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("bigint").alias("n_items"),
        (-best["item"]).alias("item_id"), best["share"].alias("coverage"),
    )


@query
def op3_maxent_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log10 probability of every document under the model and under the unigram base."""
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(False))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = maxent.fit_and_score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_chat_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, read back from the tree's tokens."""
    vocabulary = public_vocabulary("byte_bpe_50k.json")
    told = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    stream, ways = chat.format_conversations(told.union(spark.createDataFrame(odd, told.schema)), vocabulary)
    return chat.read_back(stream, ways, vocabulary)


@query
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    found = substrings.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL["op11_lexical_search"] = f"""WITH split AS (SELECT doc_id, {_TERMS} AS t FROM documents),
doc AS (SELECT doc_id, len(t) AS n FROM split WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM doc),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM split)
  WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * docs) // terms AS BIGINT)))) AS worth
  FROM tf JOIN weight USING (term) JOIN doc USING (doc_id), total),
scored AS (SELECT item_id, doc_id, CAST(sum(worth * times) AS BIGINT) AS score FROM part JOIN wanted USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""


def _reopened(told: DataFrame) -> DataFrame:
    """Each conversation behind the first turns of the one its hundred starts with, as the contract has it."""
    conv = F.col("conv_id")
    heads = told.where(conv % 100 == 0).select(conv.alias("head"), F.slice("turns", 1, 5).alias("opening"))
    h = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    own = told.select("conv_id", "turns", (conv - conv % 100).alias("head"), h.alias("h")).join(heads, "head", "left")
    opening = F.coalesce("opening", F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns") + 1)
    return own.select("conv_id", F.concat(F.slice(opening, F.lit(1), F.col("h")), rest).alias("turns"))


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the trie of conversations that open like the first of their hundred."""
    return trie.prefix_trie(_reopened(trie.sequences(table(spark, sf, "conversations"))))


ORACLE_SQL["op13_conversation_prefix_trie"] = """WITH RECURSIVE
said AS (SELECT conv_id, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM said),
crc AS (SELECT c, s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM conv UNION ALL
  SELECT c, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(s[i // 8 + 1])) ELSE v END AS x FROM crc WHERE i < 8 * length(s))),
head AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
rebuilt AS (SELECT c, key, text, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d FROM (
  SELECT c, 0 AS part, k, key, text FROM head JOIN said ON conv_id = c - c % 100 AND k <= h UNION ALL
  SELECT c, 1 AS part, k, key, text FROM head JOIN said ON conv_id = c AND k > h)),
path AS (SELECT c, d, text, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS p FROM rebuilt
  UNION ALL SELECT c, 0, '', '' FROM conv),
ended AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM (
  SELECT c, arg_max(p, d) AS p FROM path GROUP BY c) GROUP BY p),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(length(text)) AS size FROM path GROUP BY p, d),
kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
below AS (SELECT a.p, sum((b.n_children = 0)::INT) AS n_leaves, sum((b.n - 1) * b.size) AS saved FROM tree a JOIN tree b ON starts_with(b.p, a.p) GROUP BY a.p)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, t.n AS n_convs, CAST(t.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM tree t JOIN below USING (p) LEFT JOIN ended USING (p)
LEFT JOIN node up ON up.d = t.d - 1 AND up.p = left(t.p, length(t.p) - 32)"""


@query
def op12_mixture_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in 2048-token sequences that hold the sources in proportion; one row per piece."""
    return mixture.pack(table(spark, sf, "documents"), public_vocabulary()).drop("source")
