"""Code repositories: facts per repository, activity, spend ratio, languages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.functions import active_in_window, parse_date, percent_text, ratio, recode
from civicgauge.operators.aggregate import concat_all_by, count_when, dealt, sum_or_zero
from civicgauge.operators.joins import join_natural
from civicgauge.operators.project import drop_incomplete, drop_members
from civicgauge.operators.ranking import share_in_group, top_n_with_other, with_order_rank
from civicgauge.operators.reshape import item_counts, item_matrix
from civicgauge.plans import fixed_values as fixed
from civicgauge.sources.headers import read_by_header

REPO_SCHEMA = (
    "repo_url string, description string, languages string, num_commits bigint, first_commit_date string, "
    "last_commit_date string, num_contributors bigint, contributor_usernames string, agency string, organization string"
)


def repo_facts(
    repos: DataFrame, languages: DataFrame, commits: DataFrame, contributors: DataFrame, key: str = "repo",
    parts: int | None = None,
) -> DataFrame:
    """One row per repository from landed records: languages, commits, first and last commit, contributors.

    Each child table is reduced to one row per repository before it is joined, and all meet on the same key, so
    their shuffles are shared. An empty repository (size 0) keeps its row with nulls; one without commits has 0.
    ``parts``: partitions that all of them are dealt over, for tables whose share of a session's fixed number is too much
    for one task.
    """
    history = commits.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_commits"), F.min("author_date").alias("first_commit_date"),
        F.max("author_date").alias("last_commit_date"))
    people = concat_all_by(contributors, [key], "login", "contributor_usernames", count="num_contributors", parts=parts)
    written_in = concat_all_by(languages, [key], "language", "languages", parts=parts)
    out = dealt(repos, parts, key)
    for side in (written_in, dealt(history, parts, key), people):
        out = out.join(side, key, "left")
    has_content = F.col("size") > 0
    children = ["languages", "first_commit_date", "last_commit_date", "num_contributors", "contributor_usernames"]
    return out.withColumns({
        **{c: F.when(has_content, F.col(c)) for c in ["description", *children] if c in out.columns},
        "num_commits": F.when(has_content, F.coalesce(F.col("num_commits"), F.lit(0)))})


def read_repos(spark: SparkSession, *folders: str) -> DataFrame:
    """The per-organisation CSV files of several folder trees, stacked by their headers."""
    return read_by_header(spark, list(folders), REPO_SCHEMA, multi_line=True)


def with_commit_days(repos: DataFrame) -> DataFrame:
    """ISO commit times as dates."""
    return repos.withColumns({c: parse_date(c) for c in ("first_commit_date", "last_commit_date")})


def repos_in_window(
    repos: DataFrame, start: str = fixed.REPO_WINDOW[0], end: str = fixed.REPO_WINDOW[1],
    name_fixes: Mapping[str, Iterable[str]] = fixed.REPO_AGENCY_FIXES,
) -> DataFrame:
    """Repositories active in the window, agency names fixed. Commit columns are dates or timestamps."""
    kept = repos.filter(active_in_window("first_commit_date", "last_commit_date", start, end))
    return kept.withColumn("agency", recode("agency", name_fixes))


def repo_activity(repos: DataFrame, recent_after: str = fixed.RECENT_COMMITS_AFTER) -> DataFrame:
    """Per agency: repositories, commits, contributors, recently active repositories and their share."""
    recent = F.col("last_commit_date") >= F.date_add(F.lit(recent_after).cast("date"), 1)
    out = repos.groupBy(F.col("agency").alias("sub_agency")).agg(
        count_when(recent).alias("repo_commits_6m"), sum_or_zero("num_commits").alias("num_commits"),
        sum_or_zero("num_contributors").alias("num_contributors"), F.count(F.lit(1)).alias("num_repos"))
    return out.withColumn("per_repos_commits_6m", ratio("repo_commits_6m", "num_repos"))


def repos_per_million(activity: DataFrame, spend: DataFrame, complete: bool = True) -> DataFrame:
    """Repositories per million of spending; agencies without spending or repositories are left out if ``complete``."""
    joined = join_natural(spend, activity, "left" if complete else "full")
    joined = drop_incomplete(joined, ["total_funding", "num_repos"]) if complete else joined
    return joined.withColumn("repo_per_million", ratio("num_repos", "total_funding"))


def language_counts(repos: DataFrame) -> DataFrame:
    """(agency, language, repositories), for any number of languages."""
    return item_counts(repos, ["agency"], "repo_url", "languages")


def language_counts_of(repos: DataFrame, languages: DataFrame, key: str = "repo") -> DataFrame:
    """The same from the landed rows of (repository, language), where the repositories keep their key: no text is taken apart."""
    held = languages.select(key, F.col("language").alias("languages")).join(repos.select(key, "agency"), key)
    return held.groupBy("agency", "languages").agg(F.count_distinct(key).alias("count"))


def language_matrix(repos: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Agency x language counts of repositories, one column per listed language."""
    return item_matrix(repos, ["agency"], "repo_url", "languages", languages)


def language_top(
    counts: DataFrame, names: DataFrame, n: int = 5, not_languages: Iterable[str] = tuple(fixed.NOT_A_LANGUAGE),
    flags: DataFrame | None = None,
) -> DataFrame:
    """Top n languages per agency and ``Other``, share in the agency, display rank of the language.

    ``names`` (sub_agency, sub_agency_abbrev) lists the agencies to show; ``flags`` (sub_agency, benchmark) marks some.
    """
    shown = drop_members(counts.withColumnRenamed("agency", "sub_agency"), "languages", not_languages).join(
        names, "sub_agency", "right").filter(F.col("languages").isNotNull())
    per_name = shown.groupBy("sub_agency_abbrev", "languages").agg(F.sum("count").alias("count"))
    top = top_n_with_other(per_name, ["sub_agency_abbrev"], "languages", "count", n)
    shares = share_in_group(top, ["sub_agency_abbrev"], "count", reduced=True)
    out = with_order_rank(shares, "languages", "count", last="Other").join(names, "sub_agency_abbrev", "left")
    return out if flags is None else out.join(flags, "sub_agency", "left")


def agency_order(df: DataFrame) -> DataFrame:
    """Agencies in display order: unmarked before marked, then by name."""
    marked = df.select("sub_agency_abbrev", "benchmark").distinct()
    position = F.struct("benchmark", "sub_agency_abbrev")
    return marked.withColumn("position", position).orderBy("position").drop("position")


def repo_table(indicator: DataFrame, names: DataFrame) -> DataFrame:
    """Presentation table: short names, rounded ratio, share as text."""
    return join_natural(indicator, names, "left").select(
        "sub_agency_abbrev", "sub_agency", "num_repos", "num_contributors", "num_commits",
        F.round("repo_per_million", 3).alias("repo_per_million"), percent_text("per_repos_commits_6m").alias("per_repos_commits_6m"))
