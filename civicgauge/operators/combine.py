"""Stacking and removing repeats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column missing in one table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_strict(*tables: DataFrame) -> DataFrame:
    """Stack tables with the same columns in any order; other columns are an error."""
    names = set(tables[0].columns)
    if any(set(t.columns) != names for t in tables):
        raise ValueError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), tables)


def distinct_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Without exact repeats, after dropping volatile columns."""
    return df.drop(*ignore).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
