"""Quality rules and a hashed n-gram log-likelihood ratio, all in DataFrame functions.

Words and pairs of neighbouring words are hashed into buckets. The trusted documents and the whole
corpus each give a smoothed multinomial over the buckets, and a document's score is the mean, over
its n-grams, of the log ratio of the two. Documents at or above a fixed threshold pass.

Bucket counts are combined in each task, and the table of ratios has one entry per bucket whatever
the corpus, so a document is scored where it is read, without a shuffle of texts or words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ALPHA = 1.0  # added to each bucket's count
THRESHOLD = -0.1
WINDOW = 8  # words of a repeated window: pairs of pairs of pairs
SMALL_ROWS = 1_000_000  # trusted ids up to this many are broadcast
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30


def let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def word_array(text: Column) -> Column:
    """Runs of characters other than blank and tab to carriage return."""
    spaced = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def paired(hashes: Column, apart: int = 1) -> Column:
    """Hashes of the pairs of elements so far apart."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def buckets(hashes: Column, pairs: Column, n: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbours, both given by hash."""
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Words inside a window of `WINDOW` words that occurs twice or more, the first included.

    A window's hash is one of two halves', and so on down to the pairs of neighbours.
    """
    width = WINDOW

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))

            tied = F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
            return F.array_sort(F.filter(tied, lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(
            let(order, positions), start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0))

    windows = let(let(pairs, lambda h: paired(h, 2)), lambda h: paired(h, 4))
    return F.when(F.size(hashes) <= width, F.lit(0)).otherwise(let(windows, covered))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def bucket_counts(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """`(bucket, raw, target)`: n-grams of all given texts, and of those whose `trusted` is true."""
    hashes = word_hashes(F.coalesce(F.col("text"), F.lit("")))
    spread = docs.select("trusted", F.explode(let(hashes, lambda h: buckets(h, paired(h), n))).alias("bucket"))
    return spread.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row `ratios`: per bucket, the log of its trusted probability over its corpus probability.

    `trusted` holds distinct non-null `doc_id`s.
    """
    spark = docs.sparkSession
    ids = trusted.withColumn("trusted", F.lit(True))
    ids = F.broadcast(ids) if trusted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else ids
    marked = docs.join(ids, "doc_id", "left")
    both = spark.range(n).select(F.col("id").cast("int").alias("bucket")).join(bucket_counts(marked, n), "bucket", "left")
    parts = F.collect_list(F.struct("bucket", F.coalesce("target", F.lit(0)).alias("t"), F.coalesce("raw", F.lit(0)).alias("r")))
    row = both.agg(F.array_sort(parts).alias("b"), F.coalesce(F.sum("target"), F.lit(0)).alias("nt"), F.coalesce(F.sum("raw"), F.lit(0)).alias("nr"))
    ratio = F.transform("b", lambda x: F.log((x["t"] + alpha) / (x["r"] + alpha)) - F.log((F.col("nt") + alpha * n) / (F.col("nr") + alpha * n)))
    return row.select(ratio.alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS) -> DataFrame:
    """Rule counts, score and verdict of every document (`doc_id, text`).

    `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`.

    Cases: a null or blank text has no words, score 0 and fails the rules; `trusted` (`doc_id`) may
    repeat ids or hold nulls; with no trusted document every ratio is that of the smoothing alone;
    rows that repeat are judged each; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trusted = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    docs = docs.withColumn("ratios", log_ratios(docs, trusted, n).scalar())
    text = F.col("text")

    def score(h: Column, pairs: Column, table: Column) -> Column:
        total = F.aggregate(buckets(h, pairs, n), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        grams = F.greatest(2 * F.size(h) - 1, F.lit(1))
        return F.when(F.size(h) > 0, total / grams).otherwise(F.lit(0.0))

    measured = let(word_hashes(text), lambda h: let(paired(h), lambda pairs: F.struct(
        F.size(h).cast("bigint").alias("n_words"),
        repeated_words(h, pairs).cast("bigint").alias("n_repeat_words"),
        let(F.col("ratios"), lambda table: score(h, pairs, table)).alias("score"),
    )))
    rows = docs.select(
        "doc_id", measured.alias("m"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        duplicate_lines(text).cast("bigint").alias("n_dup_lines"),
    )
    failed = (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > MOST_REPEATED * F.col("m.n_words"))
    return rows.select(
        "doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
        failed.alias("base_failed"), "m.score", (~failed & (F.col("m.score") >= threshold)).alias("kept"),
    )
