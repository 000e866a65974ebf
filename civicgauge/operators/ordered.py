"""Running values over rows in order, without one task that sees all rows or a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.session import durable
from civicgauge.sources.readers import literal_table

PART, ROW = "__part", "__row"

#: The aggregate of a kind of value, and how a value and the one of the rows before it make one, in Spark and on the driver.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, lambda a, b: a + b), "min": (F.min, F.least, min), "max": (F.max, F.greatest, max),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a ^ b)}


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Adds to each row the values of its group up to and with itself: ``{"so_far": ("sum", F.col("n"))}``.

    The rows are dealt to ranges of (group, order), so a group of any size lies in as many ranges as it needs. Values are
    summed within each range, and each range is told what its first group amounts to in the ranges before: what comes to the
    driver, and goes out again, is one entry for each range. Null values are skipped; a value is null until the first one
    that is not. Null groups are a group, before all others. Rows that are equal in group and order follow each other in no
    stated order.
    """
    placed = df.withColumn(ROW, F.monotonically_increasing_id())
    placed = durable(placed.repartitionByRange(*[F.col(g).asc() for g in group], *order, ROW).withColumn(PART, F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy(PART, *group).orderBy(*order, ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumns({n: KINDS[kind][0](c).over(so_far) for n, (kind, c) in values.items()})
    before = _before(placed, group, values)
    if before is None:
        return counted.drop(PART, ROW)
    # One row for each range at most, so Spark sends the table to all tasks.
    found = counted.join(before, [*(F.col(g).eqNullSafe(F.col(f"__group_{i}")) for i, g in enumerate(group)), F.col(PART) == F.col("__at")], "left")
    joined = {n: F.coalesce(KINDS[kind][1](F.col(n), F.col(f"__before_{n}")), F.col(n), F.col(f"__before_{n}")) for n, (kind, _) in values.items()}
    return found.withColumns(joined).select(*df.columns, *values)


def _before(placed: DataFrame, group: Sequence[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame | None:
    """``__at``, ``__group_<i>`` and ``__before_<name>``: the first group of each range that began before it, and its values there."""
    key = F.struct(*group) if group else F.struct(F.lit(0))
    totals = [KINDS[kind][0](c).alias(n) for n, (kind, c) in values.items()]
    ends = placed.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    last = placed.join(ends, PART).filter(key.eqNullSafe(F.col("last"))).groupBy(PART, "first", "last").agg(*totals)
    ranges = last.agg(F.array_sort(F.collect_list(F.struct(PART, "first", "last", *values))).alias("ranges"))
    found, before = [], None
    for r in ranges.first()["ranges"]:
        sums = {n: r[n] for n in values}
        if before and before[0] == r["first"]:
            found.append((r[PART], *(r["first"] if group else ()), *before[1].values()))
            if r["first"] == r["last"]:
                sums = {n: _folded(kind, before[1][n], sums[n]) for n, (kind, _) in values.items()}
        before = r["last"], sums
    if not found:
        return None
    kinds = last.schema
    fields = [T.StructField("__at", T.IntegerType())]
    fields += [T.StructField(f"__group_{i}", f.dataType) for i, f in enumerate(kinds["first"].dataType.fields if group else ())]
    return literal_table(placed.sparkSession, found, T.StructType([*fields, *[T.StructField(f"__before_{n}", kinds[n].dataType) for n in values]]))


def _folded(kind: str, before: object, own: object) -> object:
    return own if before is None else before if own is None else KINDS[kind][2](before, own)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """Adds the number of each row within its group in the given order, from 1."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("bigint"))})
