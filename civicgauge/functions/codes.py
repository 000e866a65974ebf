"""Code lists and rules. The lists are arguments: short, fixed, and written into the plan as literals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicgauge.functions.text import as_column, list_items

KEEP = object()
"""Marks a recode whose unmatched values stay as they are."""


def pad_code(code: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer codes stay whole (``lpad`` alone would cut them)."""
    value = as_column(code).cast("string")
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def recode(value: Column | str, groups: Mapping[str, Iterable[str]], default: object = KEEP) -> Column:
    """Many-to-one mapping ``{new: [old, ...]}``; the first group holding the value wins."""
    column = as_column(value)
    otherwise = column if default is KEEP else F.lit(default)
    # Built from the last group backwards so that the first one ends up outermost.
    pairs = reversed(list(groups.items()))
    return reduce(lambda rest, pair: F.when(column.isin(list(pair[1])), F.lit(pair[0])).otherwise(rest), pairs, otherwise)


def group_of(value: Column | str, groups: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """The name of the group a value belongs to."""
    return recode(value, groups, default)


def first_rule(rules: Sequence[tuple[str, str, str]], default: str | None = None) -> Column:
    """First matching ``(column, value, result)`` rule, over any number of columns."""
    return reduce(
        lambda rest, rule: F.when(F.col(rule[0]) == rule[1], F.lit(rule[2])).otherwise(rest),
        reversed(rules), F.lit(default).cast("string"),
    )


def classify_tiers(
    code: Column | str, outside: Iterable[str], tiers: Mapping[str, Iterable[str]], outside_label: str, inside_label: str,
) -> Column:
    """Named tiers first, then ``outside_label`` for sentinel codes, ``inside_label`` for every other code.

    A null code is not a sentinel, so it counts as inside.
    """
    column = as_column(code)
    is_outside = F.coalesce(column.isin(list(outside)), F.lit(False))
    rest = F.when(is_outside, F.lit(outside_label)).otherwise(F.lit(inside_label))
    return F.coalesce(group_of(column, tiers), rest)


def crosswalk_band(grade: Column | str, to_base: Mapping[str, Iterable[str]], bands: Mapping[str, Iterable[str]]) -> Column:
    """Map foreign grades to the base scale, then to a band. Grades on neither list give null."""
    return group_of(recode(grade, to_base), bands)


def label_codes(text: Column | str, labels: Mapping[str, str], separator: str = ", ", first_only: bool = False) -> Column:
    """Append the label of each listed code (or of the first one) to the delimited code text. Codes match exactly."""
    value = as_column(text)
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.array_compact(F.transform(list_items(value, separator), lambda code: F.try_element_at(lookup, code)))
    found = F.slice(found, 1, 1) if first_only else found
    return F.when(F.size(found) > 0, F.concat_ws(separator, value, F.array_join(found, separator))).otherwise(value)
