"""Code repositories on customers: orders are commits, suppliers contributors, part brands languages, supplier balance spending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.plans import opensource as jobs
from civicgauge.session import scratch_path
from civicgauge.sources.readers import literal_table
from civicgauge.sources.writers import write_table_csv
from queries import stand_ins as data
from queries.registry import load, query

WINDOW = ("2001-01-01", "1996-01-01")
"""A repository counts if its first commit is before 1996 and its last one after the first day of 2001."""
RECENT = "2001-07-01"
NOT_LANGUAGES = ["Brand#24", "Brand#25"]
LANGUAGES = [f"Brand#{i}" for i in range(1, 26)]

KEPT_SQL = data.REPO_SQL + """,
kept AS (
  SELECT * FROM repo WHERE CAST(first_commit_date AS DATE) < DATE '1996-01-01' AND CAST(last_commit_date AS DATE) > DATE '2001-01-01'
)"""
ACTIVITY_SQL = KEPT_SQL + """,
activity AS (
  SELECT agency AS sub_agency, count(*) FILTER (CAST(last_commit_date AS DATE) > DATE '2001-07-01') AS repo_commits_6m,
    CAST(sum(num_commits) AS BIGINT) AS num_commits, CAST(coalesce(sum(num_contributors), 0) AS BIGINT) AS num_contributors,
    count(*) AS num_repos, count(*) FILTER (CAST(last_commit_date AS DATE) > DATE '2001-07-01') / CAST(count(*) AS DOUBLE) AS per_repos_commits_6m
  FROM kept GROUP BY agency
)"""
MILLION_SQL = ACTIVITY_SQL + "," + data.SPEND_SQL + """,
indicator AS (
  SELECT sub_agency, total_funding, benchmark, repo_commits_6m, num_commits, num_contributors, num_repos, per_repos_commits_6m,
    num_repos / nullif(total_funding, 0) AS repo_per_million FROM spend JOIN activity USING (sub_agency) WHERE total_funding IS NOT NULL
)"""
COUNTS_SQL = KEPT_SQL + """,
counts AS (
  SELECT agency, languages, count(*) AS count
  FROM (SELECT agency, repo_url, unnest(string_split(languages, ', ')) AS languages FROM kept) GROUP BY agency, languages
)"""


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.repos_in_window(data.repos(spark, folder), start=WINDOW[0], end=WINDOW[1])


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Agency names to show: all but the last, and one without data."""
    shown = load(spark, folder, "nation").filter(F.col("n_name") != "NATION_24").select(
        F.col("n_name").alias("sub_agency"), F.regexp_replace("n_name", "NATION_", "N").alias("sub_agency_abbrev"))
    return shown.union(literal_table(spark, [("No Such Agency", "NSA")], shown.schema))


@query("""
WITH commits AS (
  SELECT o_custkey AS repo, count(*) AS n, min(o_orderdate) AS first_commit_date, max(o_orderdate) AS last_commit_date FROM orders GROUP BY o_custkey
),
children AS (
  SELECT o_custkey AS repo, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS languages, count(DISTINCT l_suppkey) AS num_contributors,
    string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS contributor_usernames
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey
)
SELECT c_custkey AS repo, c_name AS repo_url, n_name AS agency, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS size,
  CASE WHEN c_acctbal > 0 THEN coalesce(n, 0) END AS num_commits, CASE WHEN c_acctbal > 0 THEN first_commit_date END AS first_commit_date,
  CASE WHEN c_acctbal > 0 THEN last_commit_date END AS last_commit_date, CASE WHEN c_acctbal > 0 THEN languages END AS languages,
  CASE WHEN c_acctbal > 0 THEN num_contributors END AS num_contributors,
  CASE WHEN c_acctbal > 0 THEN contributor_usernames END AS contributor_usernames
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN commits ON commits.repo = c_custkey LEFT JOIN children ON children.repo = c_custkey
""")
def repo_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without a positive balance are empty repositories."""
    return jobs.repo_facts(**data.repo_records(spark, folder))


@query("WITH" + KEPT_SQL + " SELECT * FROM kept")
def repos_in_window(spark: SparkSession, folder: str) -> DataFrame:
    return kept(spark, folder).select(
        "repo_url", "agency", "num_commits", "first_commit_date", "last_commit_date", "num_contributors", "languages")


@query("WITH" + ACTIVITY_SQL + " SELECT * FROM activity")
def repo_activity(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.repo_activity(kept(spark, folder), RECENT)


def indicator(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.repos_per_million(jobs.repo_activity(kept(spark, folder), RECENT), data.spend(spark, folder))


@query("WITH" + MILLION_SQL + " SELECT * FROM indicator")
def repos_per_million(spark: SparkSession, folder: str) -> DataFrame:
    return indicator(spark, folder)


@query("WITH" + MILLION_SQL + """
SELECT CASE WHEN sub_agency <> 'NATION_24' THEN replace(sub_agency, 'NATION_', 'N') END AS sub_agency_abbrev, sub_agency, num_repos,
  num_contributors, num_commits, round(repo_per_million, 3) AS repo_per_million,
  CAST(round(per_repos_commits_6m * 100) AS BIGINT) || '%' AS per_repos_commits_6m FROM indicator
""")
def repo_table(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.repo_table(indicator(spark, folder), names(spark, folder))


@query("WITH" + COUNTS_SQL + " SELECT * FROM counts")
def language_counts(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.language_counts(kept(spark, folder))


@query("WITH" + COUNTS_SQL + "SELECT agency, " + ", ".join(
    f"CAST(coalesce(sum(count) FILTER (languages = '{b}'), 0) AS BIGINT) AS \"{b}\"" for b in LANGUAGES) + " FROM counts GROUP BY agency")
def language_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.language_matrix(kept(spark, folder), LANGUAGES)


@query("WITH" + COUNTS_SQL + "," + data.SPEND_SQL + """,
r AS (
  SELECT replace(agency, 'NATION_', 'N') AS sub_agency_abbrev, languages, count,
    row_number() OVER (PARTITION BY agency ORDER BY count DESC, languages) AS rn
  FROM counts WHERE languages NOT IN ('Brand#24', 'Brand#25') AND agency <> 'NATION_24'
),
t AS (
  SELECT sub_agency_abbrev, CASE WHEN rn <= 5 THEN languages ELSE 'Other' END AS languages, CAST(sum(count) AS BIGINT) AS count
  FROM r GROUP BY ALL
),
o AS (
  SELECT languages, CAST(row_number() OVER (ORDER BY languages = 'Other', sum(count) DESC, languages) AS INTEGER) AS sort_rank
  FROM t GROUP BY languages
)
SELECT t.languages, t.sub_agency_abbrev, count, count / CAST(sum(count) OVER (PARTITION BY t.sub_agency_abbrev) AS DOUBLE) AS percent,
  sort_rank, sub_agency, benchmark
FROM t JOIN o ON o.languages = t.languages JOIN spend ON replace(sub_agency, 'NATION_', 'N') = t.sub_agency_abbrev
""")
def language_top5(spark: SparkSession, folder: str) -> DataFrame:
    flags = data.spend(spark, folder).select("sub_agency", "benchmark")
    counts = jobs.language_counts_of(kept(spark, folder), data.repo_records(spark, folder)["languages"])
    return jobs.language_top(counts, names(spark, folder), 5, NOT_LANGUAGES, flags)


@query("WITH" + data.SPEND_SQL + """
SELECT DISTINCT replace(sub_agency, 'NATION_', 'N') AS sub_agency_abbrev, benchmark FROM spend WHERE sub_agency <> 'NATION_24'
""")
def agency_display_order(spark: SparkSession, folder: str) -> DataFrame:
    """Agencies in display order: unmarked before marked, then by name."""
    return jobs.agency_order(data.spend(spark, folder).join(names(spark, folder), "sub_agency"))


@query("WITH" + data.REPO_SQL + """
SELECT repo_url, CAST(NULL AS VARCHAR) AS description, languages, num_commits, CAST(first_commit_date AS DATE) AS first_commit_date, CAST(last_commit_date AS DATE) AS last_commit_date,
  num_contributors, CAST(NULL AS VARCHAR) AS contributor_usernames, agency, CASE WHEN num_commits > 10 THEN 'large' ELSE 'small' END AS organization
FROM repo
""")
def repos_landed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two organisations, with columns in two orders and without some, read by their headers; commit times as dates."""
    path, time = scratch_path(spark, "repos"), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    rows = data.repos(spark, folder).select("repo_url", "agency", "languages", "num_commits", "num_contributors", *[
        F.date_format(c, time).alias(c) for c in ("first_commit_date", "last_commit_date")])
    rows = rows.withColumn("organization", F.when(F.col("num_commits") > 10, "large").otherwise("small"))
    write_table_csv(rows.filter("organization = 'large'"), f"{path}/large")
    write_table_csv(rows.filter("organization = 'small'").select(*reversed(rows.columns)), f"{path}/small")
    return jobs.with_commit_days(jobs.read_repos(spark, f"{path}/large", f"{path}/small"))
