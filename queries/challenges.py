"""Prize challenges on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.plans import challenges as jobs
from queries import stand_ins as data
from queries.registry import load, query

NAMES = {"first_year": 1995, "last_year": 2001}
TYPED = {"types": data.TYPES, "tech": "Tech"}


@query("""
WITH span AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, c_mktsegment, n_name, n_nationkey,
    max(l_shipdate) AS shipped
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY ALL
)
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS challenge_id, c_mktsegment AS department,
  CASE WHEN o_orderstatus <> 'P' THEN n_name END AS sub_agency,
  CAST(o_orderdate AS DATE) AS start_date, CAST(year(o_orderdate) AS INTEGER) AS start_year,
  CAST(shipped AS DATE) AS end_date, CAST(year(shipped) AS INTEGER) AS end_year,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)) AS INTEGER) AS duration_days,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE floor(o_totalprice) END AS prize_num,
  CASE WHEN o_orderstatus <> 'P' AND n_nationkey <= 15 THEN n_name END AS tidy_agy,
  CASE WHEN o_orderstatus = 'P' OR n_nationkey > 15 THEN 'Other Agency' WHEN n_nationkey <= 9 THEN 'Environmental Agency'
    ELSE 'Benchmark Agency' END AS env_flag,
  CASE WHEN o_orderstatus = 'P' OR n_nationkey > 15 THEN NULL WHEN n_nationkey <= 5 THEN 'Field'
    WHEN n_nationkey <= 9 THEN 'Regulatory' ELSE 'Research' END AS category,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Tech' WHEN o_orderpriority = '3-MEDIUM' THEN 'Creative'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Ideas' END AS tidy_challenge_type,
  DATE '2002-01-01' AS date_last_data
FROM span
""")
def challenges_tidy(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping yearly extracts with text dates, text prizes and both dash kinds, cleaned to one row each."""
    last = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(last, "o_orderkey", "left")
    status = F.col("o_orderstatus")
    extract = rows.select(
        F.col("o_orderkey").cast("string").alias("Challenge ID"),
        F.when(status == "F", F.concat_ws(" - ", "c_mktsegment", "n_name")).when(
            status == "O", F.concat_ws(" – ", "c_mktsegment", "n_name")).otherwise(F.col("c_mktsegment")).alias("Primary Agency Name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("Challenge Start Date"),
        F.date_format("shipped", "yyyy-MM-dd").alias("Challenge End Date"),
        F.when(status == "F", "No monetary prize for this challenge").when(
            status == "O", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).otherwise(
            F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("Prize Amount"),
        F.col("o_orderpriority").alias("Primary Challenge Type"))
    started = F.col("Challenge Start Date")
    early, late = extract.filter(started < "1999"), extract.filter(started >= "1998").withColumn("URL", F.lit(None).cast("string"))
    names = data.ENVIRONMENTAL + data.BENCHMARK
    tidy = jobs.challenges_tidy(
        early, late, entity_rules=[("sub_agency", n, n) for n in names], flags=data.FLAGS, categories=data.CATEGORIES,
        types=data.TYPE_GROUPS, as_of="2002-01-01")
    return tidy.select(
        "challenge_id", "department", "sub_agency", "start_date", "start_year", "end_date", "end_year", "duration_days",
        "prize_num", "tidy_agy", "env_flag", "category", "tidy_challenge_type", "date_last_data")


@query("WITH" + data.CHALLENGE_SQL + """
SELECT start_year, env_flag, count(*) FILTER (tidy_challenge_type = 'Tech') AS "Tech",
  count(*) FILTER (tidy_challenge_type = 'Creative') AS "Creative", count(*) FILTER (tidy_challenge_type = 'Ideas') AS "Ideas",
  count(DISTINCT department) AS env_agencies, count(tidy_challenge_type) AS total_env_challenges,
  count(*) FILTER (tidy_challenge_type = 'Tech') / CAST(count(DISTINCT department) AS DOUBLE) AS tech_enviro
FROM challenge WHERE start_year >= 1996 AND env_flag <> 'Other Agency' GROUP BY start_year, env_flag
""")
def tech_per_member_trend(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.tech_per_agency_trend(data.challenges(spark, folder), 1996, **TYPED)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT tidy_agy, env_flag, category, count(tidy_challenge_type) AS total_challenges,
  count(*) FILTER (tidy_challenge_type = 'Tech') AS total_tech_challenges,
  count(*) FILTER (tidy_challenge_type = 'Tech') / CAST(nullif(count(tidy_challenge_type), 0) AS DOUBLE) AS tech_nontech_chal
FROM challenge WHERE start_year BETWEEN 1995 AND 2001 AND env_flag <> 'Other Agency' GROUP BY tidy_agy, env_flag, category
""")
def entity_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.agency_breakdown(data.challenges(spark, folder), **NAMES, **TYPED)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT n_name AS tidy_agy, count(tidy_agy) AS total_challenges, count(*) FILTER (tidy_challenge_type = 'Tech') AS tech_chal
FROM nation LEFT JOIN challenge ON tidy_agy = n_name AND start_year BETWEEN 1995 AND 2001 GROUP BY n_name
""")
def entity_totals(spark: SparkSession, folder: str) -> DataFrame:
    entities = load(spark, folder, "nation").select(F.col("n_name").alias("tidy_agy"))
    return jobs.entity_totals(data.challenges(spark, folder), entities, **NAMES, tech="Tech")


@query("WITH" + data.CHALLENGE_SQL + """,
f AS (
  SELECT env_flag, count(DISTINCT CASE WHEN env_flag <> 'Other Agency' THEN tidy_agy ELSE primary_agency_name END) AS unique_agencies,
    count(tidy_challenge_type) AS total_challenges, count(*) FILTER (tidy_challenge_type = 'Tech') AS total_tech_challenges
  FROM challenge WHERE start_year BETWEEN 1995 AND 2001 GROUP BY env_flag
)
SELECT *, total_tech_challenges / CAST(total_challenges AS DOUBLE) AS tech_nontech_chal,
  total_challenges / CAST(unique_agencies AS DOUBLE) AS average_total_chal,
  total_tech_challenges / CAST(unique_agencies AS DOUBLE) AS average_tech_chal
FROM f
""")
def flag_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.flag_breakdown(data.challenges(spark, folder), **NAMES, **TYPED)


@query("WITH" + data.CHALLENGE_SQL + """,
t AS (
  SELECT env_flag, coalesce(tidy_challenge_type, primary_challenge_type) AS primary_challenge_type, start_year, department
  FROM challenge WHERE start_year >= 1996 AND start_year < 2001
),
m AS (SELECT env_flag, start_year, count(DISTINCT department) AS total_agencies FROM t GROUP BY env_flag, start_year)
SELECT env_flag, primary_challenge_type, start_year, count(*) AS total_challenges, any_value(total_agencies) AS total_agencies,
  count(*) / CAST(any_value(total_agencies) AS DOUBLE) AS chal_per_agency
FROM t JOIN m USING (env_flag, start_year) GROUP BY env_flag, primary_challenge_type, start_year
""")
def type_by_year_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.type_by_year_normalised(
        data.challenges(spark, folder), None, data.TYPE_GROUPS, first_year=1996, before_year=2001)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT env_flag, CASE WHEN tidy_challenge_type = 'Tech' THEN 'Tech' ELSE primary_challenge_type END AS primary_challenge_type,
  start_year, count(*) AS total_challenges, count(DISTINCT department) AS total_agencies,
  count(*) / CAST(count(DISTINCT department) AS DOUBLE) AS chal_per_agency
FROM challenge WHERE start_year >= 1995 AND start_year < 2002 AND primary_challenge_type NOT IN ('5-LOW')
GROUP BY ALL
""")
def type_by_year_per_type_members(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.type_by_year_normalised(
        data.challenges(spark, folder), None, {"Tech": data.TYPE_GROUPS["Tech"]}, first_year=1995, before_year=2002,
        drop_types=["5-LOW"], per_type_members=True)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT env_flag, start_year, count(*) AS total_challenges, count(DISTINCT department) AS total_agencies,
  count(*) / CAST(count(DISTINCT department) AS DOUBLE) AS chal_per_agency,
  CASE env_flag WHEN 'Environmental Agency' THEN 'environmental' WHEN 'Benchmark Agency' THEN 'other' ELSE env_flag END AS tag
FROM challenge WHERE start_year >= 1995 AND start_year < 2002 GROUP BY env_flag, start_year
""")
def total_by_year_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.total_by_year_normalised(
        data.challenges(spark, folder), None, 1995, 2002, {"Environmental Agency": "environmental", "Benchmark Agency": "other"})


@query("WITH" + data.CHALLENGE_SQL + """
SELECT department, env_flag, count(*) AS total_challenges FROM challenge GROUP BY department, env_flag
""")
def member_totals(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.member_totals(data.challenges(spark, folder), None)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT m.department, m.env_flag, t.name AS primary_challenge_type, count(c.challenge_id) AS tech_challenges
FROM (SELECT DISTINCT department, env_flag FROM challenge) m
  CROSS JOIN (VALUES ('Tech'), ('Creative'), ('Ideas'), ('5-LOW')) t(name)
  LEFT JOIN challenge c ON c.department = m.department AND c.env_flag = m.env_flag
    AND coalesce(c.tidy_challenge_type, c.primary_challenge_type) = t.name
GROUP BY ALL
""")
def member_type_dense(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.member_type_dense(data.challenges(spark, folder), [*data.TYPES, "5-LOW"], None, data.TYPE_GROUPS)


@query("WITH" + data.ENDED_SQL + """
SELECT env_flag, start_year, avg(duration_days) AS mean_duration_days, avg(prize_num) AS mean_prize
FROM ended GROUP BY env_flag, start_year
""")
def prize_duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.prize_duration_stats(data.ended_challenges(spark, folder))


@query("WITH" + data.ENDED_SQL + """,
s AS (
  SELECT env_flag, start_year, avg(duration_days) AS mean_duration_days, avg(prize_num) AS mean_prize
  FROM ended GROUP BY env_flag, start_year
)
SELECT env_flag, start_year, 'mean_duration_days' AS name, mean_duration_days AS value FROM s
UNION ALL SELECT env_flag, start_year, 'mean_prize', mean_prize FROM s
""")
def prize_duration_long(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.prize_duration_stats(data.ended_challenges(spark, folder), long=True)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT env_flag, count(*) FILTER (prize_num = 0) AS no_prize, count(*) AS total,
  count(*) FILTER (prize_num = 0) / CAST(count(*) AS DOUBLE) * 100 AS percentage
FROM challenge GROUP BY env_flag
""")
def no_prize_share(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.no_prize_share(data.challenges(spark, folder))


@query("WITH" + data.CHALLENGE_SQL + """,
p AS (
  SELECT env_flag, count(*) FILTER (prize_num = 0) / CAST(count(*) AS DOUBLE) * 100 AS percentage FROM challenge GROUP BY env_flag
)
SELECT a.percentage - b.percentage AS percent_gap FROM p a, p b
WHERE a.env_flag = 'Environmental Agency' AND b.env_flag = 'Benchmark Agency'
""")
def no_prize_gap(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.no_prize_gap(data.challenges(spark, folder), "Environmental Agency", "Benchmark Agency")


TREND_SQL = """
SELECT {keys}, CAST(regr_count({y}, start_year) AS BIGINT) AS n_points, round(regr_slope({y}, start_year), 6) AS slope,
  round(regr_intercept({y}, start_year), 4) AS intercept, round(regr_r2({y}, start_year), 6) AS r2,
  round(sqrt(greatest(regr_syy({y}, start_year) - regr_sxy({y}, start_year) * regr_sxy({y}, start_year)
    / regr_sxx({y}, start_year), 0) / ((count(*) - 2) * regr_sxx({y}, start_year))), 6) AS slope_se
FROM y GROUP BY {keys}
"""


def _shown(trends: DataFrame) -> DataFrame:
    """Fitted values rounded: the last bits of a double sum depend on the order of its rows."""
    return trends.withColumns({c: F.round(c, 4 if c == "intercept" else 6) for c in ("slope", "intercept", "r2", "slope_se")})


@query("WITH" + data.CHALLENGE_SQL + """,
y AS (SELECT env_flag, start_year, count(*) AS n FROM challenge GROUP BY env_flag, start_year)
""" + TREND_SQL.format(keys="env_flag", y="n"))
def challenge_trends(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(jobs.challenge_trends(data.challenges(spark, folder)))


@query("WITH" + data.CHALLENGE_SQL + """,
y AS (SELECT env_flag, primary_challenge_type, start_year, count(*) AS n FROM challenge GROUP BY ALL)
""" + TREND_SQL.format(keys="env_flag, primary_challenge_type", y="n"))
def challenge_trends_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(jobs.challenge_trends(data.challenges(spark, folder), ["env_flag", "primary_challenge_type"]))


@query("WITH" + data.CHALLENGE_SQL + """,
s AS (
  SELECT 'all' AS scenario, * FROM challenge UNION ALL
  SELECT 'without', * FROM challenge WHERE department NOT IN ('Customer#000000001', 'Customer#000000002')
),
y AS (
  SELECT scenario, env_flag, start_year, count(*) / CAST(count(DISTINCT department) AS DOUBLE) AS n
  FROM s GROUP BY scenario, env_flag, start_year
)
""" + TREND_SQL.format(keys="scenario, env_flag", y="n"))
def trend_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(jobs.challenge_trends(
        data.challenges(spark, folder), per_agency=True, exclude=["Customer#000000001", "Customer#000000002"]))


@query("WITH" + data.CHALLENGE_SQL + """,
g AS (
  SELECT CASE WHEN grouping(start_year) = 1 THEN 'All' ELSE CAST(start_year AS VARCHAR) END AS start_year, env_flag,
    count(*) AS n, """ + ", ".join(f"count(*) FILTER (primary_challenge_type = '{t}') AS \"{t}\"" for t in data.RAW_TYPES) + """
  FROM challenge GROUP BY GROUPING SETS ((start_year, env_flag), ())
)
SELECT start_year, env_flag, """ + ", ".join(f'"{t}" / CAST(n AS DOUBLE) AS "{t}"' for t in data.RAW_TYPES) + """,
  n / CAST(n AS DOUBLE) AS "All" FROM g
""")
def type_share_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.type_share_crosstab(data.challenges(spark, folder), data.RAW_TYPES)


@query("WITH" + data.CHALLENGE_SQL + """
SELECT start_year, env_flag, 'Agencies' AS name, count(DISTINCT department) AS value FROM challenge GROUP BY ALL
UNION ALL SELECT start_year, env_flag, 'Challenges', count(*) FROM challenge GROUP BY ALL
""")
def participation(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.participation(data.challenges(spark, folder))


@query("WITH" + data.CHALLENGE_SQL + """,
c AS (SELECT env_flag, department, count(*) AS count FROM challenge GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, env_flag, department) AS rn FROM c)
SELECT env_flag, department, count FROM r WHERE rn <= 20 OR department = 'Customer#000000004'
""")
def top_departments(spark: SparkSession, folder: str) -> DataFrame:
    """A top-20 report plus one named department."""
    return jobs.top_departments(data.challenges(spark, folder), 20, also=F.col("department") == "Customer#000000004")


@query("WITH" + data.CHALLENGE_SQL + """
SELECT CASE WHEN contains(primary_agency_name, 'BUILD') OR contains(primary_agency_name, '_12') THEN 'Environmental / Natural Resource Agencies' ELSE 'All Other Agencies' END AS name_flag,
  count(*) AS n FROM challenge GROUP BY ALL
""")
def flags_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier flag, by parts of the agency name."""
    flagged = data.challenges(spark, folder).withColumn("name_flag", jobs.name_based_group("primary_agency_name", ["BUILD", "_12"]))
    return flagged.groupBy("name_flag").agg(F.count(F.lit(1)).alias("n"))
