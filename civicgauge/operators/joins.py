"""Equi-joins.

No join here carries a broadcast hint: Spark broadcasts a side only when its size is below
``spark.sql.autoBroadcastJoinThreshold`` (checked again at run time by adaptive execution), and otherwise sorts and
merges, splitting partitions that one hot key has made large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join keys with different names; the right key columns are dropped. ``null_safe`` lets null match null."""
    renamed = right.withColumnsRenamed({r: f"__right_{r}" for r in on.values()})
    pairs = [(F.col(l), F.col(f"__right_{r}")) for l, r in on.items()]
    test = reduce(and_, [l.eqNullSafe(r) if null_safe else l == r for l, r in pairs])
    joined = left.join(renamed, test, how)
    if how in ("right", "full", "outer", "right_outer", "full_outer"):
        joined = joined.withColumns({l: F.coalesce(F.col(l), F.col(f"__right_{r}")) for l, r in on.items()})
    return joined.drop(*[f"__right_{r}" for r in on.values()])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return join_on(left, right, {k: k for k in keys}, how, null_safe=True)


def join_natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common column names."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables share no column")
    return left.join(right, common, how)


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a check that stops the job if a key occurs twice. Keys with a null match nothing and may repeat.

    The check is a scalar subquery that reads the keys only, so ``df`` itself keeps its size estimate for the join.
    """
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    most = counted.agg(F.max("__n")).scalar()
    error = F.raise_error(F.lit(f"more than one row for a value of {', '.join(keys)}")).cast("boolean")
    return df.filter(F.when(F.coalesce(most, F.lit(0)) <= 1, True).otherwise(error))


def enrich_star(
    fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str] | Mapping[str, str]]], how: str = "left",
    check_unique: bool = False,
) -> DataFrame:
    """Join a fact table to its dimensions, each given with its keys. With ``left`` no fact row is lost.

    ``check_unique`` stops the job when a dimension repeats a key, which would multiply fact rows.
    """
    for dimension, on in dimensions:
        pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
        side = unique_by(dimension, list(pairs.values())) if check_unique else dimension
        fact = join_on(fact, side, pairs, how)
    return fact


def keep_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``; null matches null."""
    return _existence(df, other, keys, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``; null matches null."""
    return _existence(df, other, keys, "left_anti")


def _existence(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    # Distinct keys are formed before the shuffle, so a key with many copies in ``other`` travels once per task.
    known = other.select(*[F.col(k).alias(f"__right_{k}") for k in keys]).distinct()
    test = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return df.join(known, test, how)


def with_group_total(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], reduced: bool = False) -> DataFrame:
    """Add aggregates of each row's group to the row.

    The totals are aggregated first (partial sums in every task) and joined back, so a group holding a large part of all
    rows is never gathered in one task, as a window over the group would do. This evaluates ``df`` twice.

    ``reduced`` says that ``df`` is an aggregate with few rows per group (years, classes, scores): then a window adds the
    totals with one evaluation of ``df``.
    """
    if reduced:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: c.over(group) for name, c in totals.items()})
    per_group = df.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    return join_null_safe(df, per_group, keys, "left")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default: object = None) -> DataFrame:
    """One value per entity from a keyed table."""
    side = table.select(F.col(table_key), F.col(value))
    joined = join_on(df, side, {key: table_key}, "left")
    return joined if default is None else joined.na.fill({value: default})


def with_scalar(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Add one global value to every row, as a scalar subquery (Spark stops the job if it returns two rows)."""
    return df.withColumn(name, one_row.scalar())


def align_columns(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Equally keyed results side by side, matched on the key (null on null) and never on position."""
    return reduce(lambda a, b: join_null_safe(a, b, list(keys), "full"), tables)


def replace_rows(df: DataFrame, fixed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose key was repaired and append the repaired rows."""
    return drop_matching(df, fixed, keys).unionByName(fixed.select(*df.columns))
