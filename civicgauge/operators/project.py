"""Columns and rows: naming, order, filters, fills, tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.functions.text import as_column
from civicgauge.operators.joins import drop_matching, keep_matching


def snake_names(headers: Sequence[str]) -> list[str]:
    """snake_case headers, repeats numbered: ``Prize Amount`` -> ``prize_amount``, ``% IT`` -> ``percent_it``."""
    taken: set[str] = set()
    names = []
    for header in headers:
        name = header.replace("%", " percent ").replace("#", " number ").replace("'", "").replace('"', "")
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
        name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() or "x"
        name = f"x{name}" if name[0].isdigit() else name
        free = next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(headers) + 2))) if n not in taken)
        taken.add(free)
        names.append(free)
    return names


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def rename_to_title(df: DataFrame, column: str, title: str) -> DataFrame:
    """Rename to a title built at run time; a missing column is an error, not a silent no-op."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.withColumnRenamed(column, title)


def relocate(df: DataFrame, columns: Sequence[str], after: str | None = None) -> DataFrame:
    """Move columns behind another one (to the front if none is named)."""
    rest = [c for c in df.columns if c not in columns]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*[F.col(f"`{c}`") for c in [*rest[:at], *columns, *rest[at:]]])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    return df.columns[df.columns.index(first):df.columns.index(last) + 1]


def between(df: DataFrame, column: Column | str, low: object = None, high: object = None, open_end: bool = False) -> DataFrame:
    """Keep low <= column <= high (``< high`` with ``open_end``); a missing bound is no bound."""
    value = as_column(column)
    if low is not None:
        df = df.filter(value >= low)
    if high is not None:
        df = df.filter(value < high if open_end else value <= high)
    return df


def keep_members(df: DataFrame, column: str, members: Iterable[object] | DataFrame) -> DataFrame:
    """Rows whose value is on the list; a DataFrame of one column serves as a long list."""
    if isinstance(members, DataFrame):
        return keep_matching(df, members.toDF(column), [column])
    return df.filter(F.col(column).isin(list(members)))


def drop_members(df: DataFrame, column: str, members: Iterable[object] | DataFrame) -> DataFrame:
    """Rows whose value is not on the list. A null value is on no list, so it stays."""
    if isinstance(members, DataFrame):
        return drop_matching(df, members.toDF(column), [column])
    return df.filter(~F.coalesce(F.col(column).isin(list(members)), F.lit(False)))


def keep_members_of_any(df: DataFrame, lists: dict[str, Iterable[object]]) -> DataFrame:
    """Rows for which at least one column is on its own list."""
    test = F.lit(False)
    for column, members in lists.items():
        test = test | F.coalesce(F.col(column).isin(list(members)), F.lit(False))
    return df.filter(test)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns) if columns else None)


def map_columns(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """The same expression over several columns, in place or as new ``<name><suffix>`` columns."""
    return df.withColumns({f"{c}{suffix}": change(F.col(c)) for c in columns})


def fill_nulls(df: DataFrame, value: object, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns else None)


def tag(df: DataFrame, **constants: object) -> DataFrame:
    """Constant provenance columns (pull date, source keyword, data-as-of)."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()})
