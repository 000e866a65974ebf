"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicgauge.functions.text import as_column, before_first


def parse_date(text: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Date part of ISO text (``2024-05-01`` or ``2024-05-01T00:00:00``); unparseable text is null."""
    return F.try_to_date(before_first(text, "T"), pattern)


def year_of(day: Column | str) -> Column:
    return F.year(as_column(day))


def quarter_label(day: Column | str) -> Column:
    """``2025 Q2``"""
    value = as_column(day)
    return F.concat(F.year(value).cast("string"), F.lit(" Q"), F.quarter(value).cast("string"))


def duration_days(start: Column | str, end: Column | str) -> Column:
    """Whole days, end day excluded."""
    return F.datediff(as_column(end), as_column(start))


def active_in_window(first: Column | str, last: Column | str, start: str, end: str) -> Column:
    """First activity on a day before ``end`` and last activity on a day after ``start``; null never matches.

    Written as plain comparisons with the column (``last >= start + 1 day``), so it works on dates and timestamps
    alike and reaches the file scan.
    """
    day_after_start = F.date_add(F.lit(start).cast("date"), 1)
    return (as_column(first) < F.lit(end).cast("date")) & (as_column(last) >= day_after_start)
