"""Workforce on lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.functions import pad_code
from civicgauge.operators.aggregate import mean_by
from civicgauge.operators.ranking import order_rank
from civicgauge.plans import staffing as jobs
from civicgauge.session import scratch_path
from civicgauge.sources.readers import literal_table
from civicgauge.sources.writers import write_table_csv
from queries import stand_ins as data
from queries.registry import load, query

ENTITY = ["clean_name", "year", "flag"]
TOTALS_SQL = data.WORKFORCE_SQL + """,
totals AS (
  SELECT clean_name, year, flag, CAST(sum(employment) FILTER (job_class IN ('STEM_analyst', 'STEM_research')) AS BIGINT) AS stem,
    CAST(sum(employment) FILTER (job_class = 'STEM_tech') AS BIGINT) AS tech,
    CAST(sum(employment) FILTER (job_class = 'NOT_STEM') AS BIGINT) AS other, CAST(sum(employment) AS BIGINT) AS total
  FROM workforce GROUP BY clean_name, year, flag
),
filled AS (
  SELECT clean_name, year, flag, coalesce(stem, 0) AS stem, coalesce(tech, 0) AS tech, coalesce(other, 0) AS other, total
  FROM totals
)"""
RATIO_SQL = TOTALS_SQL + """,
ratio AS (
  SELECT clean_name, year, flag, stem AS "STEM", tech AS "Tech", other AS "Not STEM", total AS total_employees, stem + other AS non_it,
    stem + other + tech AS total_workforce, tech / CAST(nullif(stem + other, 0) AS DOUBLE) AS ratio_tech,
    tech / CAST(nullif(stem + other + tech, 0) AS DOUBLE) * 100 AS tech_pct
  FROM filled
)"""


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.workforce_totals(data.workforce(spark, folder), ENTITY)


@query("""
SELECT lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(4, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS occ, CAST(l_suppkey AS VARCHAR) AS agysub,
  l_returnflag AS loslvl, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_quantity AS BIGINT) AS employment, p_name AS occt,
  p_type AS occtyp, s_name AS agysubt, n_name AS agyt,
  CASE l_returnflag WHEN 'A' THEN 'Less than 1 year' WHEN 'N' THEN '1 - 2 years' END AS loslvlt
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def assemble_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Fact, occupations without leading zeros, agencies, and a literal table that lacks one level."""
    fact = load(spark, folder, "lineitem").select(
        pad_code("l_partkey", 4).alias("occ"), F.col("l_suppkey").cast("string").alias("agysub"), F.col("l_returnflag").alias("loslvl"),
        F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("bigint").alias("employment"))
    occupations = load(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("occ"), F.col("p_name").alias("occt"), F.col("p_type").alias("occtyp"))
    agencies = load(spark, folder, "supplier").join(
        load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("agysub"), F.col("s_name").alias("agysubt"), F.col("n_name").alias("agyt"))
    service = literal_table(spark, [("A", "Less than 1 year"), ("N", "1 - 2 years")], "loslvl string, loslvlt string")
    columns = ["occ", "agysub", "loslvl", "year", "employment", "occt", "occtyp", "agysubt", "agyt", "loslvlt"]
    return jobs.assemble_cube(fact, occupations, agencies, service, columns, per_year=False)


FACT = "AGYSUB string, LOSLVL string, OCC string, EMPLOYMENT string"
CUBE_YEARS = [1996, 1998]


@query("""
SELECT lpad(CAST(l_partkey % 50 AS VARCHAR), 4, '0') AS occ, CAST(l_suppkey AS VARCHAR) AS agysub, l_returnflag AS loslvl, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(l_quantity AS DOUBLE) AS employment, 'O' || (l_partkey % 50) || ' of ' || year(l_shipdate) AS occt, s_name AS agysubt,
  CASE WHEN l_returnflag <> 'R' THEN 'level ' || l_returnflag END AS loslvlt
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) IN (1996, 1998)
""")
def read_cube_years(spark: SparkSession, folder: str) -> DataFrame:
    """Two years of a tree of yearly cubes, one of which holds a second file, with columns in two orders and dimensions of each year."""
    root = scratch_path(spark, "cubes")
    lines = load(spark, folder, "lineitem").withColumns({"year": F.year("l_shipdate"), "occ": F.col("l_partkey") % 50})
    fact = lines.select(F.col("l_suppkey").alias("AGYSUB"), F.col("l_returnflag").alias("LOSLVL"), pad_code("occ", 4).alias("OCC"), F.col("l_quantity").cast("int").alias("EMPLOYMENT"), "year")

    def put(rows: DataFrame, year: int, table: str) -> None:
        write_table_csv(rows, f"{root}/Cube March {year}/{table}")

    for year in (1996, 1997, 1998):
        rows = fact.filter(F.col("year") == year).drop("year")
        put(rows if year < 1998 else rows.select("OCC", "EMPLOYMENT", "AGYSUB", "LOSLVL"), year, f"FACTDATA_MAR{year}.TXT")
        put(lines.select(F.col("occ").cast("string").alias("OCC"), F.concat(F.lit("O"), "occ", F.lit(f" of {year}")).alias("OCCT")).distinct(), year, "DTocc.txt")
        put(load(spark, folder, "supplier").select(F.col("s_suppkey").alias("AGYSUB"), F.col("s_name").alias("AGYSUBT")), year, "DTagy.txt")
        put(lines.filter("l_returnflag <> 'R'").select(F.col("l_returnflag").alias("LOSLVL"), F.concat(F.lit("level "), "l_returnflag").alias("LOSLVLT")).distinct(), year, "DTloslvl.txt")
    put(fact.filter("year = 1997").drop("year"), 1998, "FACTDATA_SEP1998.TXT")
    cube = jobs.read_cube(
        spark, root, FACT, "OCC string, OCCT string", "AGYSUB string, AGYSUBT string", "LOSLVL string, LOSLVLT string", {1998: "FACTDATA_MAR1998.TXT"},
        years=CUBE_YEARS, columns=["occ", "agysub", "loslvl", "year", "employment", "occt", "agysubt", "loslvlt"])
    return jobs.with_measures(cube)


@query("""
WITH s AS (SELECT s_name, n_name, n_nationkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
SELECT s_name, n_name AS agysubt, r_name AS agyt, n_name AS clean_name,
  CASE WHEN n_nationkey <= 5 THEN 'Field' WHEN n_nationkey <= 9 THEN 'Regulatory' WHEN n_nationkey <= 15 THEN 'Research' END AS category,
  'enviro_agy' AS flag FROM s WHERE n_nationkey <= 9
UNION ALL
SELECT s_name, n_name, r_name, r_name, NULL, 'benchmark_agy' FROM s WHERE r_name IN ('ASIA', 'EUROPE')
""")
def workforce_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Bureau rules on the nation and department rules on the region; a row may satisfy both."""
    places = load(spark, folder, "supplier").join(load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cube = places.select("s_name", F.col("n_name").alias("agysubt"), F.col("r_name").alias("agyt"))
    groups = {
        "enviro_agy": [("agysubt", n, n) for n in data.ENVIRONMENTAL],
        "benchmark_agy": [("agyt", r, r) for r in ("ASIA", "EUROPE")]}
    return jobs.workforce_entities(cube, groups, data.CATEGORIES)


@query("WITH" + TOTALS_SQL + """
SELECT clean_name, year, flag, total AS total_employees, name, value, value / CAST(total AS DOUBLE) * 100 AS percent_workforce
FROM (
  SELECT clean_name, year, flag, total, 'STEM' AS name, stem AS value FROM filled
  UNION ALL SELECT clean_name, year, flag, total, 'Tech', tech FROM filled
  UNION ALL SELECT clean_name, year, flag, total, 'Not STEM', other FROM filled
)
""")
def workforce_mix(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.workforce_mix(totals(spark, folder), ENTITY)


@query("WITH" + RATIO_SQL + " SELECT * FROM ratio")
def tech_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.tech_ratio(totals(spark, folder))


@query("WITH" + RATIO_SQL + """,
newest AS (
  SELECT clean_name, year, tech_pct FROM (SELECT *, rank() OVER (PARTITION BY clean_name ORDER BY year DESC) AS r FROM ratio) WHERE r = 1
)
SELECT *, CAST(row_number() OVER (ORDER BY tech_pct DESC, clean_name) AS INTEGER) AS sort_rank FROM newest
""")
def tech_pct_latest(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.tech_pct_latest(jobs.tech_ratio(totals(spark, folder)))


CHANGE_SQL = """
SELECT {keys}, a AS first_value, b AS last_value, b - a AS net_change, (b - a) / CAST(nullif(a, 0) AS DOUBLE) * 100 AS pct_change
FROM (
  SELECT {keys}, CAST(coalesce(sum(employment) FILTER (year = 1996), 0) AS BIGINT) AS a,
    CAST(coalesce(sum(employment) FILTER (year = 2000), 0) AS BIGINT) AS b
  FROM workforce WHERE year IN (1996, 2000) GROUP BY {keys}
)
"""


@query("WITH" + data.WORKFORCE_SQL + CHANGE_SQL.format(keys="agyt, clean_name"))
def headcount_change(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.headcount_change(data.workforce(spark, folder), ["agyt", "clean_name"], 1996, 2000)


@query("WITH" + data.WORKFORCE_SQL + CHANGE_SQL.format(keys="clean_name, job_class"))
def headcount_change_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.headcount_change(data.workforce(spark, folder), ["clean_name", "job_class"], 1996, 2000)


ROLL_SQL = """
SELECT agyt, {name} AS name, '{level}' AS level, year,
  CAST(coalesce(sum(employment) FILTER (job_class IN ('STEM_analyst', 'STEM_research')), 0) AS BIGINT) AS stem,
  CAST(coalesce(sum(employment) FILTER (job_class = 'STEM_tech'), 0) AS BIGINT) AS tech,
  CAST(coalesce(sum(employment) FILTER (job_class = 'NOT_STEM'), 0) AS BIGINT) AS other, CAST(sum(employment) AS BIGINT) AS total
FROM workforce GROUP BY {keys}
"""


@query("WITH" + data.WORKFORCE_SQL + ", u AS (" + ROLL_SQL.format(name="clean_name", level="bureau", keys="agyt, clean_name, year")
       + "UNION ALL" + ROLL_SQL.format(name="agyt", level="department", keys="agyt, year") + """)
SELECT agyt, name, level, year, stem AS "STEM", tech AS "Tech", other AS "Not STEM", total AS total_employees, stem + other AS non_it,
  stem + other + tech AS total_workforce, tech / CAST(nullif(stem + other, 0) AS DOUBLE) AS ratio_tech,
  tech / CAST(nullif(stem + other + tech, 0) AS DOUBLE) * 100 AS tech_pct FROM u
""")
def department_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.department_rollup(data.workforce(spark, folder), "agyt", "clean_name")


SUPERVISOR_SQL = data.WORKFORCE_SQL + """,
levels AS (
  SELECT clean_name, year, CASE supervis WHEN 'F' THEN 'Supervisor' WHEN 'O' THEN 'Team Leader' ELSE 'Non-Supervisor' END AS supertypt,
    CAST(sum(employment) AS BIGINT) AS employees, avg(los) AS mean_los
  FROM workforce WHERE job_class = 'STEM_tech' GROUP BY ALL
),
shares AS (
  SELECT *, CAST(sum(employees) OVER (PARTITION BY clean_name, year) AS BIGINT) AS "STEM_tech",
    employees / CAST(sum(employees) OVER (PARTITION BY clean_name, year) AS DOUBLE) * 100 AS per_supervis FROM levels
)"""


def _supervisors(spark: SparkSession, folder: str) -> DataFrame:
    levels = literal_table(
        spark, [("F", "Supervisor"), ("O", "Team Leader"), ("P", "Non-Supervisor")], "supervis string, supertypt string")
    return jobs.supervisor_share(data.workforce(spark, folder), ["clean_name", "year"], levels=levels)


@query("WITH" + SUPERVISOR_SQL + " SELECT * FROM shares WHERE supertypt <> 'Non-Supervisor'")
def supervisor_share(spark: SparkSession, folder: str) -> DataFrame:
    return _supervisors(spark, folder)


@query("WITH" + SUPERVISOR_SQL + """
SELECT clean_name, supertypt, round(avg(per_supervis), 8) AS mean_pct_emp, round(avg(mean_los), 8) AS mean_los_all
FROM shares WHERE supertypt <> 'Non-Supervisor' GROUP BY clean_name, supertypt
""")
def supervisor_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = jobs.supervisor_summary(_supervisors(spark, folder), ["clean_name"])
    return out.withColumns({c: F.round(c, 8) for c in ("mean_pct_emp", "mean_los_all")})


@query("WITH" + data.WORKFORCE_SQL + """,
bands AS (
  SELECT clean_name, year, CASE WHEN occ IN ('Brand#1', 'Brand#2', 'Brand#6', 'Brand#7') THEN 'low'
    WHEN occ IN ('Brand#3', 'Brand#8') THEN 'high' END AS band, employment
  FROM workforce WHERE job_class = 'STEM_tech'
)
SELECT clean_name, year, band AS pay_scale_simple, CAST(sum(employment) AS BIGINT) AS total_emp,
  CAST(any_value(everyone) AS BIGINT) AS "all_IT", CAST(sum(employment) AS BIGINT) / CAST(any_value(everyone) AS DOUBLE) * 100 AS percent
FROM bands JOIN (SELECT clean_name, year, sum(employment) AS everyone FROM bands GROUP BY ALL) USING (clean_name, year)
WHERE band IS NOT NULL GROUP BY clean_name, year, band
""")
def grade_mix(spark: SparkSession, folder: str) -> DataFrame:
    crosswalk = {"Brand#1": ["Brand#6"], "Brand#2": ["Brand#7"], "Brand#3": ["Brand#8"]}
    bands = {"low": ["Brand#1", "Brand#2"], "high": ["Brand#3"]}
    return jobs.grade_mix(data.workforce(spark, folder), ["clean_name", "year"], "occ", crosswalk=crosswalk, bands=bands)


TRENDS_SQL = data.WORKFORCE_SQL + """,
sums AS (
  SELECT agyt, clean_name, year, CAST(sum(employment) AS BIGINT) AS total_emp,
    CAST(coalesce(sum(employment) FILTER (occ IN ('Brand#1', 'Brand#2', 'Brand#3')), 0) AS BIGINT) AS total_tech,
    CAST(coalesce(sum(employment) FILTER (stemocc NOT IN ('STANDARD', 'ECONOMY')), 0) AS BIGINT) AS total_stem,
    CAST(coalesce(sum(employment) FILTER (occ IN ('Brand#4', 'Brand#5')), 0) AS BIGINT) AS total_analyst
  FROM workforce GROUP BY agyt, clean_name, year
),
trends AS (
  SELECT *, total_tech / CAST(total_emp AS DOUBLE) * 100 AS per_in_tech, total_stem / CAST(total_emp AS DOUBLE) * 100 AS per_in_stem,
    total_analyst / CAST(total_emp AS DOUBLE) * 100 AS per_in_analyst FROM sums
)"""


def _trends(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.employment_trends(
        data.workforce(spark, folder), ["agyt", "clean_name", "year"], tech=data.TECH_BRANDS, analyst=data.ANALYST_BRANDS,
        not_stem=data.OUTSIDE_TYPES)


@query("WITH" + TRENDS_SQL + " SELECT * FROM trends")
def employment_trends(spark: SparkSession, folder: str) -> DataFrame:
    return _trends(spark, folder)


@query("WITH" + TRENDS_SQL + """
SELECT agyt, clean_name, year, total_tech / CAST(nullif(total_stem, 0) AS DOUBLE) AS ratio_tech_stem, name, value,
  CASE WHEN name LIKE 'total%' THEN 'total' ELSE 'percent' END AS type
FROM trends CROSS JOIN LATERAL (VALUES ('total_emp', CAST(total_emp AS DOUBLE)), ('total_tech', CAST(total_tech AS DOUBLE)),
  ('total_stem', CAST(total_stem AS DOUBLE)), ('total_analyst', CAST(total_analyst AS DOUBLE)), ('per_in_tech', per_in_tech),
  ('per_in_stem', per_in_stem), ('per_in_analyst', per_in_analyst)) v(name, value)
""")
def ratio_long(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.ratio_long(_trends(spark, folder), ["agyt", "clean_name", "year"])


@query("WITH" + data.WORKFORCE_SQL + """,
y AS (
  SELECT clean_name, year, CAST(coalesce(sum(employment) FILTER (occ IN ('Brand#1', 'Brand#2', 'Brand#3')), 0) AS BIGINT)
    / CAST(sum(employment) AS DOUBLE) * 100 AS pct FROM workforce GROUP BY ALL
)
SELECT clean_name, round(avg(pct), 8) AS mean_tech FROM y GROUP BY clean_name
""")
def tech_share_all(spark: SparkSession, folder: str) -> DataFrame:
    out = jobs.tech_share_all(data.workforce(spark, folder), "clean_name", tech=data.TECH_BRANDS)
    return out.withColumn("mean_tech", F.round("mean_tech", 8))


@query("WITH" + data.WORKFORCE_SQL + """
SELECT occt, occ, CAST(sum(employment) AS BIGINT) AS total_employees, CAST(sum(salary) AS DOUBLE) / count(salary) AS mean_salary,
  avg(los) AS length_of_service, CAST(sum(employment) FILTER (stemocc = 'PROMO') AS BIGINT) AS tech_total_employees,
  CAST(sum(salary) FILTER (stemocc = 'PROMO') AS DOUBLE) / count(salary) FILTER (stemocc = 'PROMO') AS tech_mean_salary,
  avg(los) FILTER (stemocc = 'PROMO') AS tech_length_of_service
FROM workforce GROUP BY occt, occ HAVING bool_or(stemocc = 'PROMO')
""")
def occupation_profile(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.occupation_profile(data.workforce(spark, folder), ["occt", "occ"], F.col("stemocc").isin(data.TECH_TYPES))


@query("WITH" + data.WORKFORCE_SQL + """,
y AS (SELECT occt, year, CAST(sum(employment) AS BIGINT) AS n FROM workforce GROUP BY ALL)
SELECT occt, avg(n) AS mean_emp FROM y GROUP BY occt ORDER BY mean_emp DESC, occt LIMIT 15
""")
def largest_units(spark: SparkSession, folder: str) -> DataFrame:
    """A top-15 report."""
    return jobs.largest_units(data.workforce(spark, folder), "occt")


@query("WITH" + data.WORKFORCE_SQL + """,
y AS (SELECT year, occt, CAST(sum(employment) AS BIGINT) AS total_employees FROM workforce GROUP BY ALL),
top AS (SELECT occt FROM y ORDER BY total_employees DESC, occt, year LIMIT 10)
SELECT * FROM y WHERE occt IN (SELECT occt FROM top)
""")
def top_occupation_trends(spark: SparkSession, folder: str) -> DataFrame:
    """All years of the occupations in a top-10 report."""
    return jobs.top_occupation_trends(data.workforce(spark, folder), n_rows=10)


@query("WITH" + RATIO_SQL + """
SELECT clean_name, CAST(row_number() OVER (ORDER BY sum("Tech") DESC, clean_name) AS INTEGER) AS sort_rank FROM ratio GROUP BY clean_name
""")
def entity_display_order(spark: SparkSession, folder: str) -> DataFrame:
    return order_rank(totals(spark, folder), "clean_name", "Tech")


@query("WITH" + data.WORKFORCE_SQL + """
SELECT CASE WHEN stemocc IN ('STANDARD', 'ECONOMY') THEN 'NOT_STEM' ELSE 'STEM' END AS broad_class, clean_name, avg(employment) AS mean_employment, avg(los) AS mean_los
FROM workforce GROUP BY ALL
""")
def broad_class_means(spark: SparkSession, folder: str) -> DataFrame:
    """STEM or not, with means."""
    rows = data.workforce(spark, folder).withColumn("broad_class", jobs.job_class_broad("stemocc", data.OUTSIDE_TYPES))
    return mean_by(rows, ["broad_class", "clean_name"], {"mean_employment": "employment", "mean_los": "los"})


@query("""
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS loc, n_name AS loct FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20
""")
def located_staff(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a known duty location and its name."""
    staff = load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("loc"))
    places = load(spark, folder, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("loc"), F.col("n_name").alias("loct"))
    return jobs.add_location(staff, places).select("c_custkey", "loc", "loct")
