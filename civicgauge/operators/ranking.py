"""Top-N, latest, shares, duplicates. A window is used only where Spark can limit each group before the shuffle, or on
rows that are already one per (group, item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgauge.functions.numbers import ratio
from civicgauge.operators.aggregate import sum_or_zero
from civicgauge.operators.joins import join_null_safe, with_group_total
from civicgauge.operators.ordered import number_rows
from civicgauge.session import durable


def top_n_per_group(
    df: DataFrame, group: Sequence[str], measure: str, tiebreak: Sequence[str], n: int, rank_name: str | None = None,
) -> DataFrame:
    """First n rows per group by descending measure; ``tiebreak`` makes the cut unique.

    Spark pushes the ``<= n`` test below the shuffle (window group limit), so each task sends at most n rows per group.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(measure), *[F.asc(t) for t in tiebreak])
    kept = df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n)
    return kept.withColumnRenamed("__rank", rank_name) if rank_name else kept.drop("__rank")


def top_n_with_other(
    df: DataFrame, group: Sequence[str], item: str, measure: str, n: int, other: str = "Other", parts: int = 64,
) -> DataFrame:
    """Top n items per group and one row with the sum of the rest; zero items are dropped.

    ``df`` holds one row per (group, item). Items are first ranked within ``parts`` slices of their group: what is not in
    the top n of its slice cannot be in the top n of the group, and is summed at once. The second ranking sees at most
    ``parts * (n + 1)`` rows per group, so a group with very many items is never sorted in one task, and ``df`` is
    evaluated once.
    """
    positive = df.filter(F.col(measure) > 0).withColumn("__part", F.pmod(F.xxhash64(item), F.lit(parts)))
    largest_first = [F.desc(measure), F.asc(item)]
    in_part = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*largest_first))
    ranked = positive.withColumn("__candidate", in_part <= n)
    candidates = ranked.groupBy(*group, "__part", "__candidate", F.when(F.col("__candidate"), F.col(item)).alias(item)).agg(
        F.sum(measure).alias(measure))
    in_group = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("__candidate"), *largest_first))
    label = F.when(F.col("__candidate") & (in_group <= n), F.col(item)).otherwise(F.lit(other))
    return candidates.withColumn(item, label).groupBy(*group, item).agg(F.sum(measure).alias(measure))


def keep_group_extreme(df: DataFrame, group: Sequence[str], column: str, reduced: bool = False) -> DataFrame:
    """Rows equal to their group's maximum, ties kept. ``reduced``: few rows per group, see ``with_group_total``."""
    newest = with_group_total(df, group, {"__max": F.max(column)}, reduced)
    return newest.filter(F.col(column) == F.col("__max")).drop("__max")


def latest_per_group(df: DataFrame, group: Sequence[str], period: str, reduced: bool = False) -> DataFrame:
    """The rows of the newest period of each group, ties kept."""
    return keep_group_extreme(df, group, period, reduced)


def share_in_group(df: DataFrame, group: Sequence[str], measure: str, name: str = "percent", reduced: bool = False) -> DataFrame:
    """Value divided by the sum over its group; all rows stay."""
    out = with_group_total(df, group, {"__total": F.sum(measure)}, reduced)
    return out.withColumn(name, ratio(measure, "__total")).drop("__total")


def mark_duplicates(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """True on the second and later rows of a key, in the order of ``order`` (which must be unique within a key).

    The first row of each key is a minimum, found with partial aggregation and joined back: copies of one key may fill a
    third of the table without being sorted in one task.
    """
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    out = with_group_total(df, key, {"__first": F.min(rank)})
    return out.withColumn(name, ~rank.eqNullSafe(F.col("__first"))).drop("__first")


def top_n_global(
    df: DataFrame, measure: str, tiebreak: Sequence[str], n: int, also: Column | None = None,
) -> DataFrame:
    """The n largest rows of the whole table, plus the rows that meet ``also``.

    ``df`` holds one row per item. Sort and limit run as one top-n per task; an ``also`` row that is in the top n already
    is not repeated.
    """
    order = [F.desc(measure), *[F.asc(t) for t in tiebreak]]
    if also is None:
        return df.orderBy(*order).limit(n)
    df = durable(df, "items")  # one row per item, written once instead of worked out three times
    top = df.orderBy(*order).limit(n)
    # Counted per row, so that equal rows of the table stay as many as they are.
    return top.unionAll(df.filter(also).select(*top.columns).exceptAll(top))


def with_order_rank(df: DataFrame, label: str, measure: str, last: str | None = None, name: str = "sort_rank") -> DataFrame:
    """Number the labels of a result for display: by descending total, with one label (``Other``) last.

    The result is written once; its labels are numbered over ranges (``number_rows``), so no task sees all of them.
    """
    df = durable(df, "ranked")
    totals = df.groupBy(label).agg(F.sum(measure).alias("__total"))
    return join_null_safe(df, _numbered(totals, label, last, name), [label], "left")


def _numbered(totals: DataFrame, label: str, last: str | None, name: str) -> DataFrame:
    """The label and its number, of one row per label."""
    is_last = (F.col(label) == last).cast("int") if last else F.lit(0)
    numbered = number_rows(totals.withColumn("__last", is_last), [], ["__last", F.desc("__total"), F.asc(label)], name)
    return numbered.select(label, F.col(name).cast("int").alias(name))


def order_rank(df: DataFrame, label: str, measure: str, last: str | None = None, name: str = "sort_rank") -> DataFrame:
    """One row per label with its display number; the labels are aggregated before they are numbered."""
    return _numbered(df.groupBy(label).agg(sum_or_zero(measure).alias("__total")), label, last, name)
