"""Daily pulls: first-seen append, consolidation of repeated hits, scoring each distinct input once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.operators.aggregate import concat_all_by, concat_distinct_by, count_by
from civicgauge.operators.combine import distinct_rows, union_by_name
from civicgauge.operators.joins import drop_matching, join_null_safe, keep_matching
from civicgauge.session import durable


def first_seen(pull: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of the pull whose id the store does not hold. Several rows of one new id all stay.

    The store is first reduced to the ids of the pull: a daily pull is small enough to be broadcast for that, so that the
    large store is scanned (its id column only) but not shuffled.
    """
    known = keep_matching(store.select(key), pull, [key])
    return drop_matching(pull, known, [key])


def append_first_seen(store: DataFrame, pull: DataFrame, key: str) -> DataFrame:
    """The store followed by the first-seen rows; stored ids never change."""
    return union_by_name(store, first_seen(pull, store, key))


def closed_since(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old pull whose id is absent from the new one."""
    return drop_matching(old, new, [key])


def consolidate_hits(
    pulls: DataFrame, key: Sequence[str], term: str, name: str = "all_keywords", volatile: Sequence[str] = (), distinct: bool = False,
) -> DataFrame:
    """The same record found by several searches -> one row with all search terms.

    By default a term found twice for an id is listed twice. Rows of an id that differ in a lasting column stay apart, each with
    the whole text: where an id has many records and hits, take ``hit_counts``.
    """
    terms = concat_distinct_by(pulls, key, {name: term}) if distinct else concat_all_by(pulls, key, term, name)
    records = distinct_rows(pulls, [term, *volatile])
    return join_null_safe(records, terms, key, "left")


def hit_counts(pulls: DataFrame, key: Sequence[str], term: str, volatile: Sequence[str] = (), name: str = "n") -> tuple[DataFrame, DataFrame]:
    """The same in two tables that do not grow with each other: how often each term found an id, and the distinct records."""
    return count_by(pulls, [*key, term], name), distinct_rows(pulls, [term, *volatile])


def enrich_unique(
    df: DataFrame, column: str, score: Callable[[pd.Series], pd.DataFrame], result: T.StructType | str,
) -> DataFrame:
    """Call an expensive scorer once per distinct value of ``column`` and join its columns back.

    ``score`` takes a batch of distinct values and returns the result columns, a row for each value under the value's
    index; rows may come in another order, but a missing one stops the job. The scored table is written to
    the shared folder, so a lost executor does not call the scorer again. Rows meet their scores on a SHA-256 digest:
    long texts are shuffled once, to form the distinct values, and not for the join. Null values are not scored.
    """
    schema = T.StructType.fromDDL(result) if isinstance(result, str) else result
    digest = F.sha2(F.col(column), 256)
    inputs = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct() \
        .select(F.sha2("value", 256).alias("__digest"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            scored = score(batch["value"])
            if len(scored) != len(batch) or not scored.index.sort_values().equals(batch.index.sort_values()):
                raise ValueError("the scorer must return one row for each value, with the values' index")
            yield pd.concat([batch["__digest"], scored.loc[batch.index]], axis=1)

    scored_schema = T.StructType([T.StructField("__digest", T.StringType()), *schema.fields])
    scored = durable(inputs.mapInPandas(run, scored_schema), "scored")
    return df.withColumn("__digest", digest).join(scored, "__digest", "left").drop("__digest")
