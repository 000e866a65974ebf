"""Operator 2: quality rules, by the log-likelihood ratio of hashed n-grams. DataFrame functions only.

Two multinomials over the buckets of hashed words and word pairs are compared: that of trusted documents and that of the
raw corpus. A text's verdict is the mean of its n-grams' log ratios (so length does not count) against a fixed threshold:
no sampling, each document is judged. The raw counts are over all documents; the trusted ones are over the documents
labelled as good, at most ``trusted_rows`` of them (those with the smallest id hashes, so the same ones in every run).
An n-gram's ratio is that of its trusted count to the count the raw corpus lets expect, both raised by ``shrink``: what is
rare anywhere speaks neither for nor against a text, so a good text that is not among the trusted ones is not rejected for
words of its own. The bucket table has ``buckets`` rows whatever the input's size, so it may be broadcast.

Plain counts come with the verdict (``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``) and rejections by
two base rules: under 50 words, or over half of the words in repeated 3-word windows.

Windows are compared by 64-bit hashes within one text.

Defined results: a null or empty text has no words and fails the base rules; without trusted rows every ratio is 0, so
only the base rules reject; repeated rows (same id, same or other text) are judged each on their own; an empty table gives
an empty table; columns of the input with names used here do not clash, as only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.grams import BUCKETS, bounded_labels, gram_buckets, hashes_of, with_word_hashes, words_of
from civicgauge.session import durable

SYMBOLS = "[#*$%&|<>]"
TRUSTED_ROWS = 50_000
SHRINK = 5.0
THRESHOLD = -0.12


def _text_counts(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """One row for each row of ``docs``: row number, id, the counts of the base rules, and the word hashes."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(id_column), value.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("word_hashes", hashes_of(F.col("words")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    n = F.size("word_hashes")
    windows = F.transform("word_hashes", lambda h, i: F.xxhash64(
        h, F.get(F.col("word_hashes"), i + 1), F.get(F.col("word_hashes"), i + 2)))
    rows = rows.select(
        "row_number", id_column, F.xxhash64("text").alias("text_hash"), "word_hashes", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.slice(windows, 1, F.greatest(n - 2, F.lit(0))).alias("windows"))
    # Only texts with a repeated window are sorted.
    none = F.expr("cast(array() as array<struct<hash: bigint, at: int>>)")
    rows = rows.withColumn("in_order", F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))).otherwise(none)).drop("windows")
    rows = rows.withColumn("repeated", F.array_sort(F.transform(
        F.filter("in_order", lambda x, i: (F.get(F.col("in_order"), i - 1)["hash"] == x["hash"])
                 | (F.get(F.col("in_order"), i + 1)["hash"] == x["hash"])), lambda x: x["at"]))).drop("in_order")
    # A repeated window covers three words, or as many as there are up to the next one.
    new_words = F.zip_with("repeated", F.slice(F.col("repeated"), 2, F.size("repeated") + 1),
                           lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.aggregate(new_words, F.lit(0).cast("long"), lambda s, x: s + x)).drop("repeated")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, shrink: float = SHRINK, text: str = "text",
               id_column: str = "doc_id") -> DataFrame:
    """``bucket`` and ``log_ratio`` of each bucket the corpus uses. ``trusted``: a bounded table of ids."""
    ids = trusted.select(F.col(id_column).alias("trusted_id"))
    grams = with_word_hashes(docs.select(F.col(id_column).alias("row_id"), F.col(text).alias("text")))
    grams = grams.join(F.broadcast(ids), F.col("row_id") == F.col("trusted_id"), "left")
    # The lists are made before they are taken apart: so Spark compiles the loop over a list together with the count. An inner
    # explode would put a test of each list's size below its making, and make the lists again.
    grams = grams.select(F.col("trusted_id").isNotNull().cast("long").alias("is_trusted"), gram_buckets(F.col("word_hashes"), buckets).alias("all_buckets"))
    grams = grams.select("is_trusted", F.explode_outer("all_buckets").alias("bucket")).filter(F.col("bucket").isNotNull())
    # At most `buckets` rows, written so that the corpus is counted once.
    counts = durable(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("is_trusted").alias("good")), "gram-counts")
    all_raw, all_good = counts.agg(F.sum("raw")).scalar(), counts.agg(F.sum("good")).scalar()
    ratio = F.when(all_good > 0, F.log((F.col("good") + shrink) / (F.col("raw") * all_good / all_raw + shrink))).otherwise(0.0)
    return counts.select("bucket", ratio.alias("log_ratio"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, shrink: float = SHRINK,
          trusted_rows: int = TRUSTED_ROWS, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Counts and verdict of each row of ``docs`` (with its number and the hash of its text): ``base_failed``, ``log_ratio`` (mean; 0 without words) and ``kept``.

    ``labels`` has the id and ``quality``; rows with quality 1 are trusted.
    """
    good = bounded_labels(labels.filter(F.col("quality") == 1).select(id_column), trusted_rows, id_column)
    model = log_ratios(docs, good, buckets, shrink, text, id_column)
    counts = _text_counts(docs, text, id_column)
    keys = ["row_number", id_column, "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = counts.select(*keys, gram_buckets(F.col("word_hashes"), buckets).alias("all_buckets")).select(
        *keys, F.explode_outer("all_buckets").alias("bucket"))
    # All n-grams of a row are in one task: the sum is finished there but for one row to shuffle.
    scored = grams.join(F.broadcast(model), "bucket", "left").groupBy(*keys).agg(F.avg("log_ratio").alias("mean_ratio"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    mean = F.coalesce(F.col("mean_ratio"), F.lit(0.0))
    return scored.select(*keys, failed.alias("base_failed"), mean.alias("log_ratio"), (~failed & (mean >= threshold)).alias("kept"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def keep_good(docs: DataFrame, verdicts: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    rejected = verdicts.filter(~F.col("kept")).select(F.col(id_column).alias("rejected_id"), F.col("text_hash").alias("rejected_hash"))
    same = F.col(id_column).eqNullSafe(F.col("rejected_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("rejected_hash"))
    return docs.join(rejected, same, "left_anti")
