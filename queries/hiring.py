"""Job postings on documents, announcements on orders, openings on lineitem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.functions import count_term, normalise_bool, parse_object, to_number
from civicgauge.operators.incremental import consolidate_hits
from civicgauge.plans import hiring as jobs
from queries import stand_ins as data
from queries.registry import ORACLES, load, query


def _list(template: str, separator: str = ", ", names: list[str] = data.KEYWORDS) -> str:
    return separator.join(template.format(k=k) for k in names)


# ---- tidy tables ----

@query("""
SELECT o_orderkey || '--' || o_custkey AS unique_id, CAST(o_orderdate AS DATE) AS open_date_clean, CAST(o_orderdate AS DATE) + 10 AS close_date_clean,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'IT' ELSE 'not_IT' END AS it_flag, CAST(year(o_orderdate) AS INTEGER) AS open_year
FROM orders
""")
def history_tidy(spark: SparkSession, folder: str) -> DataFrame:
    """Announcement history with dates as text and nested series."""
    series = F.when(F.col("o_orderpriority") == "1-URGENT", "2210").otherwise("0301")
    history = load(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("usajobs_control_number"), F.col("o_custkey").cast("string").alias("announcement_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("position_open_date"),
        F.date_format(F.date_add("o_orderdate", 10), "yyyy-MM-dd").alias("position_close_date"),
        F.lit(None).cast("string").alias("position_expire_date"), F.array(F.struct(series.alias("series"))).alias("job_categories"))
    return jobs.history_tidy(history).select("unique_id", "open_date_clean", "close_date_clean", "it_flag", "open_year")


@query("""
WITH d AS (
  SELECT *, 'U.s. ' || CASE lang WHEN 'en' THEN 'Fish And Wildlife' ELSE 'Forest-Service' END AS subagency,
    CASE WHEN contains(text, 'data') AND contains(text, 'trash') THEN 'Data, Geospatial' WHEN contains(text, 'data') THEN 'Data'
      WHEN contains(text, 'trash') THEN 'Geospatial' WHEN contains(text, 'idiot') THEN 'Permit' ELSE 'Technology' END AS all_keywords
  FROM documents
)
SELECT doc_id AS id, 'Src ' || replace(source, 'src', '') AS agency, replace(subagency, 'U.s.', 'U.S.') AS subagency,
  CASE WHEN lang = 'en' THEN '0' || '301, 2210' ELSE '0301' END AS all_series_code,
  CASE WHEN lang = 'en' THEN 'Information Technology, Miscellaneous' ELSE 'Miscellaneous' END AS all_series,
  DATE '2024-01-31' AS date_posted, CAST(CAST(DATE '2024-01-31' AS DATE) + CAST(n_chars AS INTEGER) AS DATE) AS date_closes,
  CAST(n_chars AS INTEGER) AS days_open, lang || ', public' AS hiring_paths,
  CASE WHEN lang = 'de' THEN '07, 99' END AS all_mco_tags, CASE WHEN lang = 'de' THEN '07, 99, STEM' END AS mco_tags_tidy,
  CAST(contains(all_keywords, 'Data') AS INTEGER) AS data, CAST(contains(all_keywords, 'Tech') AS INTEGER) AS tech,
  CAST(contains(all_keywords, 'Geospatial') AS INTEGER) AS gis,
  CAST(contains(all_keywords, 'Data') AS INTEGER) + CAST(contains(all_keywords, 'Tech') AS INTEGER)
    + CAST(contains(all_keywords, 'Geospatial') AS INTEGER) AS total_keywords,
  g.grade AS grade_type_code, CAST(n_chars AS VARCHAR) AS minimum_range, 'Per Hour' AS description,
  CAST(doc_id AS VARCHAR) || ' ' || replace(text, chr(10), '. ') AS tidy_duties
FROM d CROSS JOIN (VALUES ('GS'), ('ZP')) g(grade) WHERE all_keywords <> 'Permit'
""")
def postings_tidy(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as nested postings, children gathered over all rows of an id."""
    return _postings_tidy(spark, folder, unique_ids=False)


@query(ORACLES["postings_tidy"])
def postings_tidy_unique_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The same, children gathered within the row."""
    return _postings_tidy(spark, folder, unique_ids=True)


def _postings_tidy(spark: SparkSession, folder: str, unique_ids: bool) -> DataFrame:
    """Documents as nested postings: series, grades, paths, tags, pay and duties are arrays."""
    english = F.col("lang") == "en"
    series = "array<struct<Name:string,Code:string>>"
    it, misc = F.struct(F.lit("Information Technology"), F.lit("2210")), F.struct(F.lit("Miscellaneous"), F.lit("0301"))
    found = F.concat_ws(", ", F.when(F.contains("text", F.lit("data")), "Data"), F.when(F.contains("text", F.lit("trash")), "Geospatial"))
    other = F.when(F.contains("text", F.lit("idiot")), "Permit").otherwise("Technology")
    raw = load(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.regexp_replace("source", "src", "SRC ").alias("agency"),
        F.concat(F.lit("U.S. "), F.when(english, "FISH AND WILDLIFE").otherwise("FOREST-SERVICE")).alias("subagency"),
        F.lit("ANALYST").alias("position"), F.lit("1").alias("openings"), F.lit("2024-01-31T08:00:00").alias("date_posted"),
        F.date_add(F.lit("2024-01-31").cast("date"), F.col("n_chars").cast("int")).cast("string").alias("date_closes"),
        F.when(english, F.array(misc, it, misc)).otherwise(F.array(misc)).cast(series).alias("series"),
        F.expr("array(named_struct('Code', 'GS'), named_struct('Code', 'ZP'))").alias("grade_type"),
        F.array(F.lit("public"), F.col("lang")).alias("hiring_path"),
        F.when(F.col("lang") == "de", F.array(F.lit("99"), F.lit("07"))).otherwise(F.array().cast("array<string>")).alias("mco_tags"),
        F.array(F.struct(
            F.col("n_chars").cast("string").alias("MinimumRange"), F.lit("0").alias("MaximumRange"),
            F.lit("PH").alias("RateIntervalCode"), F.lit("Per Hour").alias("Description"))).alias("salary_rage"),
        F.split("text", "\n").alias("major_duties"), F.when(found == "", other).otherwise(found).alias("all_keywords"))
    return jobs.postings_tidy(raw, unique_ids=unique_ids).select(
        "id", "agency", "subagency", "all_series_code", "all_series", "date_posted", "date_closes", "days_open", "hiring_paths",
        "all_mco_tags", "mco_tags_tidy", "data", "tech", "gis", "total_keywords", "grade_type_code", "minimum_range", "description",
        "tidy_duties")


@query("""
WITH t AS (
  SELECT c_custkey AS id, c_mktsegment AS agency, n_name AS subagency, c_acctbal, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
)
SELECT id, subagency, CASE WHEN n_nationkey <= 5 THEN subagency ELSE agency END AS clean_name,
  CASE WHEN n_nationkey <= 5 THEN 'Field' WHEN agency = 'MACHINERY' THEN 'Research' END AS category, 'Clerk' AS position,
  CASE WHEN c_acctbal < 0 THEN c_acctbal * 2080 ELSE c_acctbal END AS min_annual_salary, '1' AS openings,
  CASE WHEN c_acctbal < 0 THEN '2210, 0301' ELSE '0301' END AS all_series_code, 'x' AS all_series, c_acctbal < 0 AS it_specialist,
  flag AS analysis_flag, '2025-06-16' AS date_last_data
FROM t JOIN (VALUES ('enviro_agy'), ('benchmark_agy')) f(flag)
  ON (flag = 'enviro_agy' AND n_nationkey <= 5) OR (flag = 'benchmark_agy' AND (n_nationkey = 12 OR agency = 'MACHINERY'))
""")
def postings_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as postings; some belong to both groups."""
    low = F.col("c_acctbal") < 0
    tidy = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("agency"), F.col("n_name").alias("subagency"),
        F.lit("Clerk").alias("position"), F.col("c_acctbal").cast("string").alias("minimum_range"),
        F.when(low, "Per Hour").otherwise("Per Year").alias("description"), F.lit("1").alias("openings"),
        F.when(low, "2210, 0301").otherwise("0301").alias("all_series_code"), F.lit("x").alias("all_series"))
    field = data.CATEGORIES["Field"]
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return jobs.postings_summary(
        tidy, [*[("subagency", n, n) for n in field], *[("agency", s, s) for s in segments]],
        {"Field": field, "Research": ["MACHINERY"]},
        groups={"enviro_agy": {"subagency": field}, "benchmark_agy": {"subagency": ["NATION_12"], "agency": ["MACHINERY"]}},
        date_last_data="2025-06-16")


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id AS usajobs_control_number, array_to_string(list_sort(list_distinct(words)), ', ') AS job_series,
  array_to_string(list_sort(list_distinct(lines)), ', ') AS job_city,
  array_to_string(list_sort(list_distinct(list_transform(lines, lambda l: l[1:1]))), ', ') AS job_state,
  array_to_string(list_sort(list_distinct(list_transform(lines, lambda l: CAST(length(l) AS VARCHAR)))), ', ') AS job_country,
  'public' AS hiring_paths_all
FROM w
""")
def children_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Words and lines of a text as the nested children of an announcement that comes in one row."""
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(
        t.alias("positionLocationCity"), t.substr(1, 1).alias("positionLocationState"), F.length(t).alias("positionLocationCountry")))
    nested = load(spark, folder, "documents").select(
        F.col("doc_id").alias("usajobs_control_number"),
        F.transform(F.split("text", " "), lambda w: F.struct(w.alias("series"))).alias("job_categories"), lines.alias("position_locations"),
        F.array(F.struct(F.lit("public").alias("hiringPath"))).alias("hiring_paths"))
    return jobs.children_consolidated(nested)


@query("""
WITH o AS (
  SELECT o_custkey AS c, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS job_series,
    array_to_string(list_sort(list(DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR))), ', ') AS job_city,
    array_to_string(list_sort(list(DISTINCT o_orderstatus)), ', ') AS job_state,
    array_to_string(list_sort(list(DISTINCT CAST(year(o_orderdate) AS VARCHAR))), ', ') AS job_country
  FROM orders GROUP BY o_custkey
)
SELECT o_custkey AS usajobs_control_number, o_orderkey, job_series, job_city, job_state, job_country, 'public' AS hiring_paths_all
FROM orders JOIN o ON o_custkey = c
""")
def children_consolidated_over_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as announcements: a customer's rows share a control number, and each gets the children of all of them."""
    day = F.to_date("o_orderdate")
    nested = load(spark, folder, "orders").select(
        F.col("o_custkey").alias("usajobs_control_number"), "o_orderkey",
        F.array(F.struct(F.col("o_orderpriority").alias("series"))).alias("job_categories"),
        F.array(F.struct(day.cast("string").alias("positionLocationCity"), F.col("o_orderstatus").alias("positionLocationState"),
                         F.year(day).cast("string").alias("positionLocationCountry"))).alias("position_locations"),
        F.array(F.struct(F.lit("public").alias("hiringPath"))).alias("hiring_paths"))
    return jobs.children_consolidated(nested)


@query("""
WITH h AS (
  SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, ', ' ORDER BY event_type) AS all_keywords FROM events GROUP BY ALL
)
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, all_keywords FROM events JOIN h USING (user_id) WHERE h.day = CAST(ts AS DATE)
""")
def postings_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Events as search hits: a (user, day) found by several event types, terms found twice listed twice."""
    hits = load(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.col("event_id").alias("page"))
    return consolidate_hits(hits, ["user_id", "day"], "event_type", volatile=["page"])


# ---- keywords ----

@query("WITH" + data.POSTING_SQL + "SELECT subagency, count(*) AS total_announcements, "
       + _list("CAST(sum({k}) AS BIGINT) AS {k}") + ", " + _list("CAST(sum({k}) AS BIGINT) / CAST(count(*) AS DOUBLE) * 100 AS {k}_pct")
       + " FROM flagged GROUP BY subagency")
def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.keyword_hits(data.postings(spark, folder))


@query("WITH" + data.POSTING_SQL + " UNION ALL ".join(
    f"(SELECT subagency, count(*) AS total_announcements, '{k}' AS name, CAST(sum({k}) AS BIGINT) / CAST(count(*) AS DOUBLE) * 100 AS value "
    "FROM flagged GROUP BY subagency)" for k in data.KEYWORDS[2:]))
def keyword_hits_long(spark: SparkSession, folder: str) -> DataFrame:
    """Without the two broadest keywords."""
    return jobs.keyword_hits_long(data.postings(spark, folder), exclude=["data", "tech"])


@query("WITH" + data.POSTING_SQL + """
SELECT subagency, total_keywords, count(*) AS total_jobs_matched, any_value(n) AS total_announcements,
  count(*) / CAST(any_value(n) AS DOUBLE) * 100 AS pct_keywords
FROM flagged JOIN (SELECT subagency, count(*) AS n FROM flagged GROUP BY subagency) USING (subagency) GROUP BY subagency, total_keywords
""")
def keyword_count_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.keyword_count_distribution(data.postings(spark, folder))


@query("WITH" + data.POSTING_SQL + """
SELECT subagency, count(*) FILTER (length(all_mco_tags) > 0) AS "MCO",
  count(*) FILTER (all_mco_tags IS NULL OR length(all_mco_tags) = 0) AS "Not MCO",
  count(*) FILTER (length(all_mco_tags) > 0) / CAST(count(*) AS DOUBLE) * 100 AS percent_mco
FROM flagged GROUP BY subagency
""")
def mission_critical_share(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.mission_critical_share(data.postings(spark, folder))


@query("WITH" + data.POSTING_SQL + ", m AS (SELECT *, CASE WHEN length(all_mco_tags) > 0 THEN 'MCO' ELSE 'Not MCO' END AS is_mco FROM flagged) "
       + " UNION ALL ".join(
    f"(SELECT subagency, is_mco, count(*) AS total_announcements, '{k}' AS name, CAST(sum({k}) AS BIGINT) / CAST(count(*) AS DOUBLE) * 100 "
    "AS value FROM m GROUP BY subagency, is_mco)" for k in data.KEYWORDS))
def mission_critical_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.mission_critical_keywords(data.postings(spark, folder))


@query("WITH" + data.POSTING_SQL
       + ", m AS (SELECT *, CAST(floor(min_annual_salary / 10000 + 0.5) AS BIGINT) * 10000 AS min_annual_salary_bin FROM flagged) "
       + " UNION ALL ".join(
    f"(SELECT subagency, min_annual_salary_bin, count(*) AS total_announcements, '{k}' AS name, "
    f"CAST(sum({k}) AS BIGINT) / CAST(count(*) AS DOUBLE) * 100 AS value FROM m GROUP BY subagency, min_annual_salary_bin)"
    for k in data.KEYWORDS))
def salary_band_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.salary_band_keywords(data.postings(spark, folder))


@query("WITH" + data.POSTING_SQL + """
SELECT subagency, count(*) AS total_jobs, count(*) FILTER (gis + innov + programming > 0) AS focus_jobs,
  count(*) FILTER (gis + innov + programming > 0 AND length(all_mco_tags) > 0) AS focus_mco, CAST(sum(gis) AS BIGINT) AS total_gis,
  CAST(sum(innov) AS BIGINT) AS total_innov, CAST(sum(programming) AS BIGINT) AS total_programming
FROM flagged GROUP BY subagency HAVING count(*) FILTER (gis + innov + programming > 0) > 0
""")
def focus_postings(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.focus_postings(data.postings(spark, folder), tags="all_mco_tags")


@query("""
SELECT doc_id, source, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n_the,
  CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS INTEGER) AS n_tion FROM documents
""")
def term_density(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of terms in each whole text."""
    return load(spark, folder, "documents").select(
        "doc_id", "source", count_term("text", "the").alias("n_the"), count_term("text", "tion").alias("n_tion"))


# ---- series ----

@query("""
WITH words AS (SELECT p_brand AS clean_name, p_type AS analysis_flag, unnest(string_split(p_name, ' ')) AS value FROM part),
counted AS (SELECT clean_name, analysis_flag, value, count(*) AS totals FROM words GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY clean_name, analysis_flag ORDER BY totals DESC, value) AS rn FROM counted
)
SELECT clean_name, analysis_flag, value, totals,
  CASE WHEN value = 'gear' THEN 'IT Management' WHEN length(value) = 4 THEN 'Series ' || value ELSE 'General' END AS all_series,
  CASE WHEN value = 'gear' THEN 'IT' ELSE 'Not IT' END AS "IT_flag", CASE WHEN value = 'gear' THEN totals ELSE 0 END AS num_it
FROM ranked WHERE rn <= 5
""")
def top_series(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as lists of codes; parts named by one four-letter word give the series its name."""
    parts = load(spark, folder, "part").select(
        F.col("p_brand").alias("clean_name"), F.col("p_type").alias("analysis_flag"),
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("all_series_code"))
    words = parts.select("clean_name", "analysis_flag", F.explode(F.split("all_series_code", ", ")).alias("all_series_code"))
    names = words.select(F.lit("none").alias("clean_name"), F.lit("none").alias("analysis_flag"), "all_series_code").distinct()
    series = parts.withColumn("all_series", F.lit(None).cast("string")).unionByName(
        names.filter(F.length("all_series_code") == 4).withColumn("all_series", F.concat(F.lit("Series "), "all_series_code")))
    top = jobs.top_series(series, unnamed="General", short_names={"IT Management": ["Series gear"]})
    return top.filter(F.col("clean_name") != "none")


# ---- IT share over time ----

PERIOD_SQL = """
announced AS (
  SELECT n_name AS clean_name, CASE WHEN n_nationkey <= 9 THEN 'enviro_agy' ELSE 'benchmark_agy' END AS type,
    CASE WHEN n_nationkey <= 5 THEN 'Field' WHEN n_nationkey <= 9 THEN 'Regulatory' WHEN n_nationkey <= 15 THEN 'Research' END AS category,
    o_orderdate AS day, year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter, o_orderpriority = '1-URGENT' AS is_it
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
posted AS (
  SELECT * FROM announced WHERE year(day) BETWEEN 1996 AND 2001 AND quarter <> '2001 Q3' AND NOT (clean_name = 'NATION_3' AND quarter = '2001 Q2')
)"""
SHARE_SQL = """
SELECT clean_name, type, category, {period} AS period, count(*) AS announcements, count(*) FILTER (is_it) AS num_it,
  count(*) FILTER (is_it) / CAST(count(*) AS DOUBLE) * 100 AS pct_it FROM posted GROUP BY clean_name, type, category, {period}
"""


def announcements(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("clean_name"), F.when(F.col("n_name").isin(data.ENVIRONMENTAL), "enviro_agy").otherwise(
            "benchmark_agy").alias("type"), data.group_of("n_name", data.CATEGORIES).alias("category"),
        F.col("o_orderdate").alias("open_date_clean"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "IT").otherwise("not_IT").alias("it_flag"))


def _share(spark: SparkSession, folder: str, by: str) -> DataFrame:
    return jobs.it_share_by_period(
        announcements(spark, folder), by=by, first_year=1996, last_year=2001, skip=["2001 Q3"], skip_for={"NATION_3": ["2001 Q2"]})


@query("WITH" + PERIOD_SQL + SHARE_SQL.format(period="quarter"))
def share_by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return _share(spark, folder, "quarter")


@query("WITH" + PERIOD_SQL + SHARE_SQL.format(period="CAST(year(day) AS INTEGER)"))
def share_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return _share(spark, folder, "year")


@query("WITH" + PERIOD_SQL + ", s AS (" + SHARE_SQL.format(period="CAST(year(day) AS INTEGER)") + """)
SELECT * FROM s WHERE period = (SELECT max(period) FROM s t WHERE t.clean_name = s.clean_name)
""")
def share_latest(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.it_share_latest(_share(spark, folder, "year"))


@query("""
SELECT n_name AS clean_name, count(*) AS total, count(*) FILTER (c_mktsegment = 'MACHINERY') AS it_postings
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def it_posting_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return jobs.it_posting_totals(rows.select(
        F.col("n_name").alias("clean_name"), (F.col("c_mktsegment") == "MACHINERY").alias("it_specialist")))


# ---- openings ----

OPENINGS_SQL = """
listed AS (
  SELECT n_name AS subagency, l_orderkey AS id, CASE WHEN l_quantity < 10 THEN 'FEW' WHEN l_quantity < 20 THEN 'mANY'
    WHEN l_quantity < 45 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS openings,
    CASE WHEN l_quantity < 10 THEN 2 WHEN l_quantity < 20 THEN 3 WHEN l_quantity < 45 THEN CAST(l_quantity AS BIGINT) END AS weight,
    l_returnflag = 'R' AS it_specialist, l_linestatus = 'O' AS user_research, l_linenumber = 1 AS agile_startup_ux,
    l_linenumber >= 6 AS use_ai, l_returnflag <> 'N' AS stem_job, CAST(l_linenumber AS DOUBLE) + 1 AS innovative_score
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def listings(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").join(load(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    quantity = F.col("l_quantity")
    text = F.when(quantity < 10, "FEW").when(quantity < 20, "mANY").when(quantity < 45, quantity.cast("int").cast("string"))
    return rows.select(
        F.col("n_name").alias("subagency"), F.col("l_orderkey").alias("id"), text.alias("openings"),
        (F.col("l_returnflag") == "R").alias("it_specialist"), (F.col("l_linestatus") == "O").alias("user_research"),
        (F.col("l_linenumber") == 1).alias("agile_startup_ux"), (F.col("l_linenumber") >= 6).alias("use_ai"),
        (F.col("l_returnflag") != "N").alias("stem_job"), (F.col("l_linenumber").cast("double") + 1).alias("innovative_score"))


@query("WITH" + OPENINGS_SQL + """
SELECT subagency, count(*) AS row_count, CAST(sum(weight) AS BIGINT) AS estimate,
  CAST(sum(weight) AS BIGINT) - count(*) AS estimated_undercount FROM listed WHERE openings IS NOT NULL GROUP BY subagency
""")
def openings_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.openings_estimate(listings(spark, folder))


@query("WITH" + OPENINGS_SQL + """
SELECT subagency, count(*) AS row_count, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS estimate,
  CAST(sum(coalesce(weight, 1)) AS BIGINT) - count(*) AS estimated_undercount FROM listed GROUP BY subagency
""")
def openings_estimate_with_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without an openings value count as one opening."""
    return jobs.openings_estimate(listings(spark, folder), null_weight=1)


@query("WITH" + OPENINGS_SQL + """,
stats AS (
  SELECT subagency, count(openings) AS num_listings, count(*) FILTER (it_specialist) AS num_tech,
    count(*) FILTER (user_research) + count(*) FILTER (agile_startup_ux) AS num_inno_processes, count(*) FILTER (use_ai) AS num_ai,
    count(*) FILTER (stem_job) AS num_stem, CAST(max(innovative_score) AS BIGINT) AS inno_max,
    count(*) FILTER (innovative_score > 5) AS inno_tendency,
    CAST(coalesce(sum(coalesce(weight, 1) - 1) FILTER (innovative_score > 5 AND coalesce(weight, 1) > 1), 0) AS BIGINT) AS inno_undercount
  FROM listed GROUP BY subagency
),
staff AS (SELECT n_name, count(*) AS total_workforce FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT stats.*, num_tech / CAST(total_workforce AS DOUBLE) AS tech_wf_ratio,
  round(num_listings * (SELECT avg(num_tech / CAST(num_listings AS DOUBLE)) FROM stats), 6) AS expected_tech
FROM stats LEFT JOIN staff ON subagency = n_name
""")
def core_stats(spark: SparkSession, folder: str) -> DataFrame:
    staff = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("total_workforce"))
    stats = jobs.hiring_core_stats(listings(spark, folder), staff, entities=None, year=None)
    return stats.withColumn("expected_tech", F.round("expected_tech", 6))


# ---- scored texts ----

@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS innovative_score,
  CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AS use_ai FROM events
""")
def parse_scored_text(spark: SparkSession, folder: str) -> DataFrame:
    """The events' object text with a flag added before or after its own key, read by one schema."""
    parsed = load(spark, folder, "events").withColumn("k", parse_object("props", "k int")["k"])
    flag = F.when(F.col("k") > 50, '"\\"yes\\""').otherwise('"false"')
    first = F.concat(F.lit('{"use_ai": '), flag, F.lit(', "innovative_score": "'), F.col("k").cast("string"), F.lit('"}'))
    last = F.concat(F.lit('{"innovative_score": "'), F.col("k").cast("string"), F.lit('", "use_ai": '), flag, F.lit("}"))
    texts = parsed.select("event_id", "event_type", F.when(F.col("value") > 10, first).otherwise(last).alias("gpt_desc"))
    return jobs.parse_scored_text(texts, schema="innovative_score string, use_ai string")


@query("""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_letters, CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS n_blanks
FROM documents
""")
def score_duties(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct text is scored once; a pure scorer stands for an expensive one."""
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_letters": texts.str.len(), "n_blanks": texts.str.count(" ")})

    docs = load(spark, folder, "documents").select("doc_id", "text")
    return jobs.score_duties(docs, score, "n_letters int, n_blanks int", "text").drop("text")


@query("""
WITH s AS (SELECT event_type AS subagency, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS innovative_score FROM events)
SELECT subagency, innovative_score, count(*) AS total_announcements, any_value(n) AS total_announcements_posted,
  count(*) / CAST(any_value(n) AS DOUBLE) * 100 AS pct_jobs
FROM s JOIN (SELECT subagency, count(*) AS n FROM s GROUP BY subagency) USING (subagency) GROUP BY subagency, innovative_score
""")
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.score_distribution(_scores(spark, folder))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    number = to_number(parse_object("props", "k string")["k"])
    return load(spark, folder, "events").select(F.col("event_type").alias("subagency"), number.alias("innovative_score"))


@query("""
SELECT event_type AS subagency, avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS mean_innov_score FROM events GROUP BY event_type
""")
def mean_score(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.mean_score(_scores(spark, folder))


@query("""
SELECT event_type AS subagency, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS innovative_score FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 60
""")
def high_scores(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.high_scores(_scores(spark, folder), least=60)


@query("""
SELECT source AS subagency, avg(quality) AS use_ai_flag, avg(toxic) AS stem_job_flag
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def flag_means(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as flag texts in several spellings; documents without a label are not counted."""
    rows = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left").select(
        F.col("source").alias("subagency"),
        F.when(F.col("quality") == 1, '"yes"').when(F.col("quality") == 0, "false}").alias("use_ai"),
        F.when(F.col("toxic") == 1, "True").when(F.col("toxic") == 0, '"no"').alias("stem_job"))
    return jobs.flag_means(rows, flags=["use_ai", "stem_job"])


@query("""
SELECT p_brand AS subagency, p_type || ', c++' AS programming_types, count(*) AS total_announcements FROM part
WHERE p_type <> 'SMALL' GROUP BY ALL
""")
def required_languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "part").select(
        F.col("p_brand").alias("subagency"),
        F.when(F.col("p_type") == "SMALL", '"None"').otherwise(F.concat(F.lit('["'), "p_type", F.lit(', c++"]'))).alias("programming_types"))
    return jobs.required_languages(rows)


@query("""
SELECT doc_id, quality = 1 AS quality_ok, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS flag FROM labels
""")
def normalised_booleans(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("quality") == 1, '"Yes"}').otherwise(' "false"')
    value = normalise_bool(text)
    return load(spark, folder, "labels").select("doc_id", value.alias("quality_ok"), value.cast("int").alias("flag"))


@query("""
SELECT doc_id AS id, lang AS agency, source AS subagency FROM documents WHERE lang IN ('en', 'fr') OR source IN ('src1', 'src2')
""")
def postings_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with the agency on one list or the subagency on another."""
    return jobs.postings_of(data.postings(spark, folder), agency=["en", "fr"], subagency=["src1", "src2"]).select("id", "agency", "subagency")
