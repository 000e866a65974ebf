"""Least squares per group and sensitivity runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend_by_group(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares y ~ x per group: slope, intercept, R2, points, standard error of the slope.

    Groups with fewer than two points (or one x value) have null coefficients.
    """
    moments = df.groupBy(*group).agg(
        F.regr_count(y, x).alias("n_points"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("__sxx"), F.regr_syy(y, x).alias("__syy"), F.regr_sxy(y, x).alias("__sxy"))
    fitted = (F.col("n_points") >= 2) & (F.col("__sxx") > 0)
    rest = F.greatest(F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")), F.lit(0.0))
    error = F.sqrt(F.try_divide(rest, (F.col("n_points") - 2) * F.col("__sxx")))
    return moments.select(
        *group, "n_points",
        *[F.when(fitted, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")],
        F.when(fitted & (F.col("n_points") > 2), error).alias("slope_se"))


def with_scenarios(df: DataFrame, member: str, excluded: Iterable[object], name: str = "scenario") -> DataFrame:
    """Each row under ``all`` and, unless its member is excluded, under ``without``.

    Meant for rows already reduced to one per (keys, member); everything after it handles both runs in one pass.
    """
    is_excluded = F.coalesce(F.col(member).isin(list(excluded)), F.lit(False))
    scenarios = F.when(is_excluded, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without")))
    return df.withColumn(name, F.explode(scenarios))
