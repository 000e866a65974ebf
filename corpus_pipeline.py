"""From raw documents to token ids: rules, near-duplicates, personal data, mixing, encoding.

Each stage takes all rows its predecessor kept and, but for the last, returns the columns of ``documents``. ``run`` writes
every stage as a table in the shared folder and reads it again, so that a lost executor repeats one stage at most.

- Of rows with the same id and text one stays; rows without an id have no group to be named by and go with the
  near-duplicates.
- Personal data is replaced by its kind in brackets, and ``n_chars`` follows the new text.
- Mixing repeats documents until every domain holds its target share of the expected tokens; it drops none, so the total is
  raised for a domain that holds more than its share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.llm import bpe, mixing, near_duplicates, personal_data, quality_rules
from civicgauge.session import durable

TARGETS = {"clean": 0.88, "toxic": 0.12}
ORACLE_SQL = None  # hashed models and encodings are no SQL; the tests run each stage against brute force


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.judge(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Shingles of five words, similarity 0.8."""
    found = near_duplicates.near_duplicates(docs, shingle=5, per_cent=80, bands=25, band_rows=4)
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # Rows of a kept id with one text are copies; the join has brought them together.
    return docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    hidden = personal_data.redact(docs, personal_data.learn(docs))
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of each document. No domain loses tokens: the total grows with that over its share."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("domain", mixing.domain_of_labels())
    return mixing.mix(docs, labels, TARGETS, keep=tuple(TARGETS), least=1.0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, at least once."""
    return mixing.repeat(docs, rates(spark, docs, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", reject_bad), ("near duplicates", one_of_each_group), ("personal data", hide_personal_data), ("mixing", mix),
    ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
