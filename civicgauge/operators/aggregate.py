"""Grouped results. All run as partial aggregates in each task followed by one shuffle of the partial rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgauge.functions.numbers import ratio, share
from civicgauge.operators.ordered import number_rows

#: Rows that a task groups at a time where a table is dealt by its size, and the tables that are small enough to be left alone.
ROWS_IN_TASK, SMALL_TABLE = 500_000, 4_000_000


def parts_for(rows: int) -> int | None:
    """Partitions to deal a table of so many rows over, so that a task's share does not grow with it; none for a small table."""
    return math.ceil(rows / ROWS_IN_TASK) if rows > SMALL_TABLE else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows with equal keys in one of ``parts`` partitions; without a number they stay, and the session deals as it does."""
    return df.repartition(parts, *keys) if parts else df


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    """Sums per group; a group of nulls only sums to 0."""
    return df.groupBy(*keys).agg(*[sum_or_zero(c).alias(name) for name, c in sums.items()])


def sum_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def count_when(condition: Column) -> Column:
    """Rows for which the condition holds; null does not count."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_when(condition: Column, value: Column | str) -> Column:
    """Sum over the rows for which the condition holds, 0 if there is none."""
    measure = F.col(value) if isinstance(value, str) else value
    return sum_or_zero(F.when(condition, measure))


def mean_by(df: DataFrame, keys: Sequence[str], means: Mapping[str, Column | str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(name) for name, c in means.items()])


def range_by(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def count_distinct_by(df: DataFrame, keys: Sequence[str], column: str, name: str = "n_distinct", approximate: bool = False) -> DataFrame:
    """Distinct non-null values per group: first distinct (group, value) pairs, then a count, so no group is gathered."""
    counter = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.groupBy(*keys).agg(counter.alias(name))


def count_non_null_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])


def count_and_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], count_name: str = "total_announcements") -> DataFrame:
    """Row count and the sums of several flag columns at once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name), *[sum_or_zero(c).alias(c) for c in columns])


def concat_distinct_by(df: DataFrame, keys: Sequence[str], lists: Mapping[str, str], separator: str = ", ") -> DataFrame:
    """Distinct values of each group in sorted order, joined to one text; a group of nulls gives null.

    ``lists`` maps the new name to the column.
    """
    rows = df.select(*keys, F.posexplode(F.array(*[F.col(c).cast("string") for c in lists.values()])).alias("__at", "__v"))
    return texts_by(rows, keys, list(lists), separator)


def texts_by(rows: DataFrame, keys: Sequence[str], names: Sequence[str], separator: str = ", ") -> DataFrame:
    """Rows (keys, __at, __v), where ``__at`` numbers the output columns, to one text per key and column.

    Copies of a (key, column, value) triple are removed before values of a key meet in one task, so what a task holds for
    a key is the text it has to return, not the key's rows.
    """
    def text(at: int) -> Column:
        values = F.sort_array(F.collect_list(F.when(F.col("__at") == at, F.col("__v"))))
        return F.when(F.size(values) > 0, F.array_join(values, separator))

    return rows.distinct().groupBy(*keys).agg(*[text(i).alias(name) for i, name in enumerate(names)])


def texts_in_parts(df: DataFrame, keys: Sequence[str], column: str, name: str, most: int = 1000, separator: str = ", ") -> DataFrame:
    """Distinct values of each group in sorted order, as texts of at most ``most`` values: (keys, part, name).

    Parts are numbered from 1. Values are numbered over ranges of (keys, value) and meet in a task one part at a time, so a
    group may have any number of them. Nulls are no values, and a group of nulls has no part.
    """
    values = df.select(*keys, F.col(column).cast("string").alias("__v")).filter(F.col("__v").isNotNull()).distinct()
    placed = number_rows(values, keys, ["__v"], "__n").withColumn("part", F.ceil(F.col("__n") / most).cast("int"))
    return placed.groupBy(*keys, "part").agg(F.array_join(F.sort_array(F.collect_list("__v")), separator).alias(name))


def concat_all_by(df: DataFrame, keys: Sequence[str], column: str, name: str, separator: str = ", ", count: str | None = None,
                  parts: int | None = None) -> DataFrame:
    """Every value of a group, repeats included, in sorted order; a group of nulls gives null. ``count`` names its rows.

    The text is as long as the group's values together, so it is meant for groups of bounded size.

    Repeats are counted per (group, value) first and written out at the end, so one row per distinct value is shuffled.
    With ``parts`` both steps are dealt over that many partitions, the first by group and value, the second by group.
    """
    counted = dealt(df, parts, *keys, column).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    return texts_by_count(dealt(counted, parts, *keys), keys, column, "__n", name, separator, count)


def texts_by_count(
    counted: DataFrame, keys: Sequence[str], column: str, times: str, name: str, separator: str = ", ", count: str | None = None,
) -> DataFrame:
    """Rows (keys, value, times) to one text per key with each value as often as ``times`` says, in sorted order."""
    word = F.struct(F.col(column).alias("value"), F.col(times).cast("int").alias("n"))
    words = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), word)))
    repeated = F.flatten(F.transform(words, lambda w: F.array_repeat(w["value"], w["n"])))
    text = F.when(F.size(repeated) > 0, F.array_join(repeated, separator)).alias(name)
    return counted.groupBy(*keys).agg(text, *([F.sum(times).cast("bigint").alias(count)] if count else []))


def crosstab_with_totals(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], measure: Column | str | None = None,
    total_label: str = "All",
) -> DataFrame:
    """Cross-tab with one column per value, an ``All`` column, and an ``All`` row.

    The data is reduced once to one row per (rows, value); the grouping sets run on that. The ``All`` row carries
    ``total_label`` in the first row key and null in the others.
    """
    cell = F.lit(1) if measure is None else measure
    cells = df.groupBy(*[F.col(r).cast("string").alias(r) for r in rows], F.col(column).alias("__value")).agg(
        sum_or_zero(cell).alias("__cell"))
    grouped = cells.groupingSets([list(map(F.col, rows)), []], *map(F.col, rows)).agg(
        F.grouping_id().alias("__total"),
        *[sum_when(F.col("__value") == v, "__cell").alias(v) for v in values],
        sum_or_zero("__cell").alias(total_label),
    )
    first = F.when(F.col("__total") > 0, F.lit(total_label)).otherwise(F.col(rows[0]))
    return grouped.withColumn(rows[0], first).drop("__total")


def per_member(
    df: DataFrame, total_keys: Sequence[str], member_keys: Sequence[str], member: str, measure: Column | str | None = None,
    total_name: str = "total", member_name: str = "members", result: str = "per_member",
) -> DataFrame:
    """Group total divided by the number of distinct members active in the (coarser) member group.

    ``member_keys`` are some or all of ``total_keys``. The data is reduced once to one row per (keys, member); grouping
    sets then give totals and member counts together, and the few totals of a member group take its count from there.
    """
    cell = F.lit(1) if measure is None else measure
    reduced = df.groupBy(*total_keys, member).agg(sum_or_zero(cell).alias("__cell"))
    figures = [sum_or_zero("__cell").alias(total_name), F.count_distinct(member).alias(member_name)]
    if set(total_keys) == set(member_keys):
        out = reduced.groupBy(*total_keys).agg(*figures)
    else:
        columns = {k: F.col(k) for k in total_keys}
        sets = [list(columns.values()), [columns[k] for k in member_keys]]
        both = reduced.groupingSets(sets, *columns.values()).agg(F.grouping_id().alias("__level"), *figures)
        coarse = F.max(F.when(F.col("__level") > 0, F.col(member_name))).over(Window.partitionBy(*member_keys))
        out = both.withColumn(member_name, coarse).filter(F.col("__level") == 0).drop("__level")
    return out.withColumn(result, ratio(total_name, member_name))


def with_shares(df: DataFrame, columns: Sequence[str], total: str, scale: float = 100.0, suffix: str = "") -> DataFrame:
    """Each column as a share of ``total``, in place or as new columns."""
    return df.withColumns({f"{c}{suffix}": share(c, total, scale) for c in columns})


def period_change(
    df: DataFrame, keys: Sequence[str], period: str, value: str, first: object, last: object,
    names: tuple[str, str] = ("first_value", "last_value"),
) -> DataFrame:
    """Value of the last period minus the first, and the change in %; a missing period counts as 0."""
    out = df.filter(F.col(period).isin([first, last])).groupBy(*keys).agg(
        sum_when(F.col(period) == first, value).alias(names[0]), sum_when(F.col(period) == last, value).alias(names[1]))
    change = F.col(names[1]) - F.col(names[0])
    return out.withColumns({"net_change": change, "pct_change": share(change, names[0])})


def mean_of_ratios(df: DataFrame, part: str, rest: str, name: str = "mean_ratio") -> DataFrame:
    """One row: the unweighted mean of the groups' ratios."""
    return df.agg(F.avg(ratio(part, rest)).alias(name))
