"""Hashed word n-grams as DataFrame expressions: the features of operators 2, 5 and 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words stand blanks and the control characters from tab to carriage return.
BETWEEN_WORDS = "[ \\t-\\r]+"
BUCKETS = 1 << 18


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def hashes_of(words: Column) -> Column:
    """The 64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def with_word_hashes(docs: DataFrame, text: str = "text", name: str = "word_hashes") -> DataFrame:
    """Adds the 64-bit hash of each word of the whole text, in order; none for a null text."""
    words = words_of(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn(name, hashes_of(words))


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def gram_buckets(hashes: Column, buckets: int = BUCKETS, pairs: bool = True, doubled: bool = False) -> Column:
    """Bucket of each word and, with ``pairs``, of each two words in a row; with ``doubled`` a word that follows itself

    gives one and the same pair whatever the word is.
    """
    single = F.transform(hashes, lambda h: bucket_of(h, buckets))
    if not pairs:
        return single

    def pair(h: Column, i: Column) -> Column:
        following = F.get(hashes, i + 1)
        both = F.xxhash64(h, following)
        return bucket_of(F.when(h == following, F.xxhash64(F.lit(0), F.lit(0))).otherwise(both) if doubled else both, buckets)

    return F.concat(single, F.slice(F.transform(hashes, pair), 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def hash_share(id_column: str, most: int, rows: int) -> Column:
    """Whether a row is in the share of all rows, by the hash of its id, that holds about twice ``most`` of ``rows``.

    It keeps what a task hands on to the choice of the smallest hashes in proportion to its part of the choice.
    """
    return F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int(min(1.0, 2 * most / max(1, rows)) * (1 << 30))


def bounded_labels(labels: DataFrame, most: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids, the same ones in every run, chosen by their hashes. Small enough to broadcast."""
    share = hash_share(id_column, most, labels.count())
    return labels.filter(F.col(id_column).isNotNull() & share).dropDuplicates([id_column]).orderBy(F.xxhash64(id_column), id_column).limit(most)


def labelled_once(labels: DataFrame, columns: dict[str, Column], id_column: str = "doc_id") -> DataFrame:
    """One row for each labelled id; of several different labels the smallest value counts. Null labels are none."""
    found = labels.select(id_column, *(c.alias(n) for n, c in columns.items()))
    return found.groupBy(id_column).agg(*(F.min(n).alias(n) for n in columns))
