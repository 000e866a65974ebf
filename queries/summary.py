"""All four indicators per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.plans import challenges, hiring, opensource, staffing, summary
from civicgauge.sources.readers import year_range
from queries import hiring as hiring_queries
from queries import opensource as repo_queries
from queries import staffing as staffing_queries
from queries import stand_ins as data
from queries.registry import load, query


@query("WITH" + staffing_queries.RATIO_SQL + "," + data.CHALLENGE_SQL + "," + hiring_queries.PERIOD_SQL
       + "," + repo_queries.MILLION_SQL + """,
it_latest AS (
  SELECT clean_name, arg_max(pct, y) AS pct
  FROM (SELECT clean_name, year(day) AS y, count(*) FILTER (is_it) / CAST(count(*) AS DOUBLE) * 100 AS pct FROM posted GROUP BY ALL)
  GROUP BY clean_name
)
SELECT n_name AS clean_name, CASE WHEN n_nationkey <= 9 THEN 'Yes' ELSE 'No' END AS flag,
  (SELECT tech_pct / 100 FROM ratio WHERE ratio.clean_name = n_name ORDER BY year DESC LIMIT 1) AS workforce_tech,
  CASE WHEN n_nationkey <= 15 THEN (SELECT count(*) FROM challenge WHERE tidy_agy = n_name AND tidy_challenge_type = 'Tech') ELSE 0 END
    AS tech_challenges,
  (SELECT pct / 100 FROM it_latest WHERE it_latest.clean_name = n_name) AS it_postings,
  (SELECT per_repos_commits_6m FROM activity WHERE sub_agency = n_name) AS active_repos,
  (SELECT repo_per_million FROM indicator WHERE sub_agency = n_name) AS repo_per_million,
  CASE WHEN n_nationkey <= 9 THEN 1 ELSE 0 END AS color_col
FROM nation
""")
def indicator_summary(spark: SparkSession, folder: str) -> DataFrame:
    def named(df: DataFrame, column: str) -> DataFrame:
        return df.withColumnRenamed(column, "clean_name")

    nations = load(spark, folder, "nation")
    entities = nations.select(
        F.col("n_name").alias("clean_name"), F.when(F.col("n_name").isin(data.ENVIRONMENTAL), "Yes").otherwise("No").alias("flag"))
    tech = staffing.tech_pct_latest(staffing.tech_ratio(staffing_queries.totals(spark, folder)))
    prizes = challenges.entity_totals(
        data.challenges(spark, folder), nations.select(F.col("n_name").alias("tidy_agy")), 1995, 2001, tech="Tech")
    posted = hiring.it_share_latest(hiring.it_share_by_period(
        hiring_queries.announcements(spark, folder), first_year=1996, last_year=2001, skip=["2001 Q3"],
        skip_for={"NATION_3": ["2001 Q2"]}))
    activity = opensource.repo_activity(repo_queries.kept(spark, folder), repo_queries.RECENT)
    repos = opensource.repos_per_million(activity, data.spend(spark, folder), complete=False)
    return summary.indicator_summary(entities, tech, named(prizes, "tidy_agy"), posted, named(repos, "sub_agency"))


@query("WITH" + staffing_queries.RATIO_SQL + """
SELECT clean_name, arg_max(tech_pct, year) AS "'01 Workforce Tech %" FROM ratio GROUP BY clean_name
""")
def summary_titles(spark: SparkSession, folder: str) -> DataFrame:
    """A title with the year it covers, which is looked up in the data."""
    tech = staffing.tech_pct_latest(staffing.tech_ratio(staffing_queries.totals(spark, folder)))
    newest = year_range(tech).first()["max_year"]
    return summary.with_titles(tech.select("clean_name", "tech_pct"), {"tech_pct": f"'{newest % 100:02d} Workforce Tech %"})
