"""Number columns: parsing, ratios, weights, exact money sums."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicgauge.functions.text import as_column


def to_number(text: Column | str, kind: str = "double") -> Column:
    """Number or null; never an error."""
    return as_column(text).try_cast(kind)


def parse_money(text: Column | str, free_pattern: str = "(?i)no", whole_units: bool = True) -> Column:
    """``"$1,000.00"`` -> 1000; text matching ``free_pattern`` -> 0; anything else -> null. Cents are cut off by default."""
    value = as_column(text)
    number = to_number(F.regexp_replace(value, r"[$,\s]", ""))
    if whole_units:
        number = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
    return F.when(value.rlike(free_pattern), F.lit(0.0)).otherwise(number)


def annualise(amount: Column | str, unit: Column | str, hourly_unit: str = "Per Hour", hours: int = 40 * 52) -> Column:
    number = to_number(amount)
    return F.when(as_column(unit) == hourly_unit, number * hours).otherwise(number)


def bin_to(value: Column | str, width: int) -> Column:
    """Nearest multiple of ``width``, halves up."""
    return (F.floor(as_column(value) / width + F.lit(0.5)) * width).cast("bigint")


def ratio(part: Column | str, rest: Column | str) -> Column:
    """Part / rest, null when the divisor is zero or null."""
    return F.try_divide(as_column(part).cast("double"), as_column(rest).cast("double"))


def share(part: Column | str, total: Column | str, scale: float = 100.0) -> Column:
    return ratio(part, total) * F.lit(scale)


def percent_text(value: Column | str) -> Column:
    """0.4454 -> ``45%``; for display."""
    return F.concat(F.round(as_column(value) * 100).cast("bigint").cast("string"), F.lit("%"))


def row_sum(columns: Iterable[Column | str]) -> Column:
    """Sum across the columns of a row, nulls as zero."""
    return reduce(add, [F.coalesce(as_column(c), F.lit(0)) for c in columns])


def word_weight(text: Column | str, weights: Mapping[str, int], null_weight: int | None = None) -> Column:
    """A number, or the least number a word stands for (``Few`` -> 2). Unknown words are null."""
    value = as_column(text)
    out = F.when(value.isNull(), F.lit(null_weight).cast("bigint"))
    for word, weight in weights.items():
        out = out.when(F.lower(value) == word.lower(), F.lit(weight).cast("bigint"))
    return out.otherwise(to_number(value, "bigint"))


def excess_over_one(weight: Column | str, condition: Column) -> Column:
    """Aggregate: sum of (weight - 1) over rows with weight > 1 that meet the condition."""
    value = as_column(weight)
    return F.coalesce(F.sum(F.when(condition & (value > 1), value - 1)), F.lit(0).cast("bigint"))


def exact_sum(value: Column | str, digits: int = 2) -> Column:
    """Aggregate: sum in fixed point. The result does not depend on how rows are spread over tasks, unlike a double sum."""
    return F.sum(as_column(value).cast(f"decimal(20,{digits})")).cast("double")


def exact_mean(value: Column | str, digits: int = 2) -> Column:
    return F.try_divide(exact_sum(value, digits), F.count(as_column(value)).cast("double"))
