"""The given tables in the shape of the indicator inputs, and the same shapes as SQL for the checks.

orders are challenges, lineitem is the workforce fact, documents are postings, customers with their orders are repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.functions import annualise, duration_days, exact_sum, group_of, hit_flags, row_sum
from civicgauge.operators.aggregate import dealt, parts_for
from civicgauge.plans.opensource import repo_facts
from civicgauge.plans.staffing import job_class
from queries.registry import load

# ---- fixed values of the stand-ins ----
ENVIRONMENTAL = [f"NATION_{i}" for i in range(10)]
BENCHMARK = [f"NATION_{i}" for i in range(10, 16)]
FLAGS = {"Environmental Agency": ENVIRONMENTAL, "Benchmark Agency": BENCHMARK}
CATEGORIES = {"Field": ENVIRONMENTAL[:6], "Regulatory": ENVIRONMENTAL[6:], "Research": BENCHMARK}
TYPE_GROUPS = {"Tech": ["1-URGENT", "2-HIGH"], "Creative": ["3-MEDIUM"], "Ideas": ["4-NOT SPECIFIED"]}
TYPES = list(TYPE_GROUPS)
RAW_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TECH_TYPES, ANALYST_TYPES, OUTSIDE_TYPES = ["PROMO"], ["SMALL"], ["STANDARD", "ECONOMY"]
TECH_BRANDS = ["Brand#1", "Brand#2", "Brand#3"]
ANALYST_BRANDS = ["Brand#4", "Brand#5"]
WORDS = {
    "data": "data", "tech": "tion", "software": "ment", "programming": "ung", "prod_manager": "queque", "steward": "sch",
    "innov": "aux", "gis": "trash",
}
KEYWORDS = list(WORDS)

# ---- challenges ----
CHALLENGE_SQL = """
challenge AS (
  SELECT o_orderkey AS challenge_id, c_name AS department, c_mktsegment || ' - ' || n_name AS primary_agency_name,
    CASE WHEN n_nationkey <= 15 THEN n_name END AS tidy_agy,
    CASE WHEN n_nationkey <= 9 THEN 'Environmental Agency' WHEN n_nationkey <= 15 THEN 'Benchmark Agency'
      ELSE 'Other Agency' END AS env_flag,
    CASE WHEN n_nationkey <= 5 THEN 'Field' WHEN n_nationkey <= 9 THEN 'Regulatory'
      WHEN n_nationkey <= 15 THEN 'Research' END AS category,
    o_orderpriority AS primary_challenge_type,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Tech' WHEN o_orderpriority = '3-MEDIUM' THEN 'Creative'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Ideas' END AS tidy_challenge_type,
    CAST(year(o_orderdate) AS INTEGER) AS start_year, CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderstatus = 'F' THEN 0 ELSE floor(o_totalprice) END AS prize_num
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
ENDED_SQL = CHALLENGE_SQL + """,
ended AS (
  SELECT challenge.*, date_diff('day', start_date, CAST(last_day AS DATE)) AS duration_days
  FROM challenge LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_orderkey)
    ON l_orderkey = challenge_id
)"""


def challenges(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = F.col("n_name").isin(ENVIRONMENTAL + BENCHMARK)
    tidy = rows.select(
        F.col("o_orderkey").alias("challenge_id"), F.col("c_name").alias("department"),
        F.concat_ws(" - ", "c_mktsegment", "n_name").alias("primary_agency_name"),
        F.when(named, F.col("n_name")).alias("tidy_agy"), F.col("o_orderpriority").alias("primary_challenge_type"),
        group_of("o_orderpriority", TYPE_GROUPS).alias("tidy_challenge_type"), F.year("o_orderdate").alias("start_year"),
        F.to_date("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.floor("o_totalprice").cast("double")).alias("prize_num"))
    return tidy.withColumns({
        "env_flag": group_of("tidy_agy", FLAGS, "Other Agency"), "category": group_of("tidy_agy", CATEGORIES)})


def ended_challenges(spark: SparkSession, folder: str) -> DataFrame:
    last = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("challenge_id")).agg(
        F.to_date(F.max("l_shipdate")).alias("end_date"))
    return challenges(spark, folder).join(last, "challenge_id", "left").withColumn(
        "duration_days", duration_days("start_date", "end_date"))


# ---- workforce ----
WORKFORCE_SQL = """
workforce AS (
  SELECT r_name AS agyt, n_name AS clean_name,
    CASE WHEN n_nationkey <= 9 THEN 'enviro_agy' ELSE 'benchmark_agy' END AS flag,
    CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_quantity AS BIGINT) AS employment,
    CAST(l_extendedprice AS DECIMAL(20, 2)) AS salary, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS los,
    p_type AS stemocc, p_brand AS occ, p_name AS occt, o_orderstatus AS supervis,
    CASE WHEN p_type = 'PROMO' THEN 'STEM_tech' WHEN p_type = 'SMALL' THEN 'STEM_analyst'
      WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'NOT_STEM' ELSE 'STEM_research' END AS job_class
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
)"""


def workforce(spark: SparkSession, folder: str) -> DataFrame:
    places = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    agencies = load(spark, folder, "orders").join(
        load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        agencies, F.col("l_orderkey") == F.col("o_orderkey"))
    cube = rows.select(
        F.col("r_name").alias("agyt"), F.col("n_name").alias("clean_name"),
        F.when(F.col("n_name").isin(ENVIRONMENTAL), "enviro_agy").otherwise("benchmark_agy").alias("flag"),
        F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("bigint").alias("employment"),
        F.col("l_extendedprice").alias("salary"), F.datediff("l_shipdate", "o_orderdate").alias("los"),
        F.col("p_type").alias("stemocc"), F.col("p_brand").alias("occ"), F.col("p_name").alias("occt"),
        F.col("o_orderstatus").alias("supervis"))
    return cube.withColumn("job_class", job_class("stemocc", TECH_TYPES, ANALYST_TYPES, OUTSIDE_TYPES))


# ---- postings ----
POSTING_SQL = """
posting AS (
  SELECT doc_id AS id, lang AS agency, source AS subagency, text, n_chars,
    CASE WHEN n_chars < 100 THEN NULL WHEN n_chars < 500 THEN 'FEW' WHEN n_chars < 2000 THEN 'mANY'
      ELSE CAST(n_chars AS VARCHAR) END AS openings,
    CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) ELSE n_chars * 2080.0 END AS min_annual_salary,
    quality, toxic,
    CASE WHEN toxic = 1 THEN '02' WHEN quality = 1 THEN '07, 10' WHEN quality = 0 THEN '' END AS all_mco_tags,
    CAST(contains(text, 'data') AS INTEGER) AS data, CAST(contains(text, 'tion') AS INTEGER) AS tech,
    CAST(contains(text, 'ment') AS INTEGER) AS software, CAST(contains(text, 'ung') AS INTEGER) AS programming,
    CAST(contains(text, 'queque') AS INTEGER) AS prod_manager, CAST(contains(text, 'sch') AS INTEGER) AS steward,
    CAST(contains(text, 'aux') AS INTEGER) AS innov, CAST(contains(text, 'trash') AS INTEGER) AS gis
  FROM documents LEFT JOIN labels USING (doc_id)
),
flagged AS (
  SELECT *, data + tech + software + programming + prod_manager + steward + innov + gis AS total_keywords FROM posting
)"""


def postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    chars = F.col("n_chars")
    flat = rows.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("agency"), F.col("source").alias("subagency"), "text", "n_chars",
        F.when(chars >= 100, F.when(chars < 500, "FEW").when(chars < 2000, "mANY").otherwise(chars.cast("string"))).alias("openings"),
        annualise("n_chars", F.when(F.col("lang") == "en", "Per Year").otherwise("Per Hour")).alias("min_annual_salary"),
        "quality", "toxic",
        F.when(F.col("toxic") == 1, "02").when(F.col("quality") == 1, "07, 10").when(F.col("quality") == 0, "").alias("all_mco_tags"),
        *[c.alias(name) for name, c in hit_flags("text", WORDS).items()])
    return flat.withColumn("total_keywords", row_sum(KEYWORDS))


# ---- repositories ----
REPO_SQL = """
repo AS (
  SELECT c_name AS repo_url, n_name AS agency, count(DISTINCT o_orderkey) AS num_commits, min(o_orderdate) AS first_commit_date,
    max(o_orderdate) AS last_commit_date, nullif(count(DISTINCT l_suppkey), 0) AS num_contributors,
    string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS languages
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY c_name, n_name
)"""
SPEND_SQL = """
spend AS (
  SELECT n_name AS sub_agency, CAST(sum(CAST(s_acctbal AS DECIMAL(20, 2))) AS DOUBLE) AS total_funding,
    CASE WHEN n_nationkey > 9 THEN 1 ELSE 0 END AS benchmark
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey
)"""


def repo_records(spark: SparkSession, folder: str) -> dict[str, DataFrame | int | None]:
    """Landed records of each repository: itself, its commits, languages and contributors, and partitions for so many lines."""
    parts = parts_for(load(spark, folder, "lineitem").count())
    owners = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("repo"), "o_orderdate")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(
        orders.select("o_orderkey", "repo"), F.col("l_orderkey") == F.col("o_orderkey"))
    brands = lines.join(load(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return {
        "repos": owners.select(
            F.col("c_custkey").alias("repo"), F.col("c_name").alias("repo_url"), F.col("n_name").alias("agency"),
            F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("size")),
        "commits": orders.select("repo", F.col("o_orderdate").alias("author_date")),
        "languages": dealt(brands.select("repo", F.col("p_brand").alias("language")), parts, "repo", "language").distinct(),
        "contributors": dealt(lines.select("repo", F.col("l_suppkey").cast("string").alias("login")), parts, "repo", "login").distinct(),
        "parts": parts,
    }


def repos(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders, in the shape of the per-organisation files."""
    records = repo_records(spark, folder)
    records["repos"] = records["repos"].withColumn("size", F.lit(1))
    return repo_facts(**records).filter(F.col("num_commits") > 0)


def spend(spark: SparkSession, folder: str) -> DataFrame:
    balance = load(spark, folder, "supplier").groupBy("s_nationkey").agg(exact_sum("s_acctbal").alias("total_funding"))
    return load(spark, folder, "nation").join(balance, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("n_name").alias("sub_agency"), "total_funding", F.when(F.col("n_nationkey") > 9, 1).otherwise(0).alias("benchmark"))
