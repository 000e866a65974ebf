"""One row per entity over all four indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.operators.project import rename_to_title


def indicator_summary(
    entities: DataFrame, staffing: DataFrame, challenges: DataFrame, hiring: DataFrame, repos: DataFrame,
    key: str = "clean_name", flag: str = "flag", marked: str = "Yes",
) -> DataFrame:
    """Newest tech %, tech challenges, IT posting %, active-repository share and repositories per million, by entity.

    Each input is one row per entity. Entities without a figure keep their row; shares are fractions.
    """
    out = entities
    for side in (
        staffing.select(key, (F.col("tech_pct") / 100).alias("workforce_tech")),
        challenges.select(key, F.col("tech_chal").alias("tech_challenges")),
        hiring.select(key, (F.col("pct_it") / 100).alias("it_postings")),
        repos.select(key, F.col("per_repos_commits_6m").alias("active_repos"), "repo_per_million"),
    ):
        out = out.join(side, key, "left")
    return out.withColumn("color_col", F.when(F.col(flag) == marked, 1).otherwise(0))


def with_titles(summary: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Column titles built at run time, e.g. with the years they cover."""
    for column, title in titles.items():
        summary = rename_to_title(summary, column, title)
    return summary
