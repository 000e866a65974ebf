"""Data-quality reports, each a DataFrame, and checks that run with a job instead of after it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from civicgauge.operators.aggregate import count_when
from civicgauge.session import durable


def duplicate_report(df: DataFrame, by: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and surplus copies per group; ``key`` limits what counts as the same row.

    Copies are counted with partial aggregation, so they never gather in one task.
    """
    columns = list(dict.fromkeys([*by, *(key or df.columns)]))
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return copies.groupBy(*by).agg(
        F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("__n") - 1).alias("duplicate_rows"))


def key_consistency(df: DataFrame, key: Sequence[str], column: str, name: str = "n_values") -> DataFrame:
    """Keys whose attribute has more than one value."""
    return df.groupBy(*key).agg(F.count_distinct(column).alias(name)).filter(F.col(name) > 1)


def range_violations(df: DataFrame, column: Column | str, low: object = None, high: object = None) -> DataFrame:
    """Rows with ``column`` < low or > high."""
    return df.filter(_outside(column, low, high))


def _outside(column: Column | str, low: object, high: object) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < low)
    if high is not None:
        outside = outside | (value > high)
    return outside


def coverage_report(df: DataFrame, entity: Sequence[str], period: str, flags: Mapping[str, Column]) -> DataFrame:
    """First and last period, rows and flagged rows per entity."""
    return df.groupBy(*entity).agg(
        F.min(period).alias("min_period"), F.max(period).alias("max_period"), F.count(F.lit(1)).alias("n_rows"),
        *[count_when(c).alias(name) for name, c in flags.items()])


def vocabulary_report(df: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    """Distinct raw values of a field with counts, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


@dataclass
class Checks:
    """Counts to take of the rows of a job as they pass, each under a name of its own.

    ``ranges`` (column, low, high) counts rows outside; ``filled`` counts nulls of columns; ``periods`` gives the first and last
    value of a column; ``vocabulary`` counts the rows of each listed value and of any other; ``flags`` counts rows that meet a
    condition. These are the figures of the reports above over the whole table, without groups; ``distinct`` estimates the
    number of different keys (to about 2 %), which ``duplicate_report`` counts.
    """

    ranges: Mapping[str, tuple[Column | str, object, object]] = field(default_factory=dict)
    filled: Iterable[str] = ()
    periods: Iterable[str] = ()
    vocabulary: Mapping[str, Iterable[str]] = field(default_factory=dict)
    flags: Mapping[str, Column] = field(default_factory=dict)
    distinct: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def metrics(self) -> dict[str, Column]:
        found = {"n_rows": F.count(F.lit(1))}
        found |= {name: count_when(_outside(*bounds)) for name, bounds in self.ranges.items()}
        found |= {f"null_{c}": count_when(F.col(c).isNull()) for c in self.filled}
        for c in self.periods:
            found |= {f"min_{c}": F.min(c), f"max_{c}": F.max(c)}
        for c, values in self.vocabulary.items():
            values = list(values)
            found |= {f"{c}_{v}": count_when(F.col(c) == v) for v in values}
            found[f"{c}_other"] = F.count(F.lit(1)) - count_when(F.col(c).isin(values))
        found |= {name: count_when(c) for name, c in self.flags.items()}
        return found | {name: F.approx_count_distinct(F.struct(*key)) for name, key in self.distinct.items()}


def observed(df: DataFrame, checks: Checks) -> tuple[DataFrame, Observation]:
    """The rows as they are, and the figures, which are there once an action on the rows has run. Nothing is read twice."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in checks.metrics().items()]), seen


def written_with_checks(df: DataFrame, checks: Checks, label: str = "checked") -> tuple[DataFrame, dict[str, object]]:
    """Write the rows to the shared folder; the written table and the figures taken on the way."""
    rows, seen = observed(df, checks)
    return durable(rows, label), seen.get


def report_of(df: DataFrame, figures: Mapping[str, object]) -> DataFrame:
    """The figures as rows (metric, value), values as text."""
    return df.sparkSession.createDataFrame([(name, None if v is None else str(v)) for name, v in figures.items()], "metric string, value string")
