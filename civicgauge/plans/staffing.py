"""Workforce: the star-schema cube, tech and STEM shares, supervisors, grades, growth."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgauge.functions import (
    classify_tiers, crosswalk_band, exact_mean, first_rule, group_of, match_any, pad_code, ratio, share, to_number,
)
from civicgauge.operators.aggregate import period_change, sum_or_zero, sum_when
from civicgauge.operators.joins import enrich_star, join_on, keep_matching, with_group_total
from civicgauge.operators.project import clean_names, relocate
from civicgauge.operators.ranking import latest_per_group, top_n_global, with_order_rank
from civicgauge.operators.reshape import unpivot_long
from civicgauge.plans import fixed_values as fixed
from civicgauge.sources.headers import read_by_header

CUBE_COLUMNS = [
    "loslvl", "agysub", "occ", "loc", "agelvl", "edlvl", "gsegrd", "patco", "ppgrd", "sallvl", "stemocc", "supervis", "toa",
    "worksch", "workstat", "datecode", "employment", "salary", "los", "occtyp", "occfam", "occfamt", "occtypt", "occt", "agytyp",
    "agytypt", "agy", "agyt", "agysubt", "loslvlt", "year",
]
CLASSES = ["STEM", "Tech", "Not STEM"]


# ---- the cube ----

def read_cube(
    spark: SparkSession, root: str, fact_schema: str, occupation_schema: str, agency_schema: str, service_schema: str,
    prefer: Mapping[int, str] | None = None, folders: str = "/*", years: Iterable[int] | None = None, check_unique: bool = True,
    columns: Sequence[str] | None = CUBE_COLUMNS,
) -> DataFrame:
    """The year folders below ``root`` as one cube: all of them, or those of ``years`` and nothing else.

    Years are told by the folders' names before anything is read, so files of other years are in no scan; ``prefer`` names the
    file of a year that has several. Columns go by the files' headers, so years may order them differently. Each fact row
    meets the dimensions of its own year.
    """
    asked = None if years is None else list(years)

    def scan(schema: str, table: str, one_of: Mapping[int, str] | None = None) -> DataFrame:
        return clean_names(read_by_header(spark, f"{root}{folders}/{table}", schema, "*", unknown="drop", year="year", years=asked, prefer=one_of))

    return assemble_cube(
        scan(fact_schema, "*FACTDATA*", prefer), scan(occupation_schema, "DTocc.txt"), scan(agency_schema, "DTagy.txt"),
        scan(service_schema, "DTloslvl.txt"), columns, check_unique)


def assemble_cube(
    fact: DataFrame, occupations: DataFrame, agencies: DataFrame, service: DataFrame, columns: Sequence[str] | None = CUBE_COLUMNS,
    check_unique: bool = True, how: str = "left", per_year: bool = True,
) -> DataFrame:
    """Fact rows with occupation, agency and length-of-service names of their own year; no fact row is lost.

    Occupation codes lose their leading zeros in the dimension file and are padded to four places. ``per_year=False``
    takes dimensions without a year.
    """
    padded = occupations.withColumn("occ", pad_code("occ", 4))
    year = ["year"] if per_year else []
    cube = enrich_star(
        fact, [(padded, ["occ", *year]), (agencies, ["agysub", *year]), (service, ["loslvl", *year])], how, check_unique)
    return cube.select(*columns) if columns else cube


def with_measures(cube: DataFrame, measures: Sequence[str] = ("employment", "salary", "los")) -> DataFrame:
    """Text measures as numbers, unparseable ones null."""
    return cube.withColumns({m: to_number(m) for m in measures if m in cube.columns})


def workforce_entities(
    cube: DataFrame, groups: Mapping[str, Sequence[tuple[str, str, str]]] | None = None,
    categories: Mapping[str, Iterable[str]] = fixed.CATEGORIES,
) -> DataFrame:
    """Rows of the chosen departments and bureaus with ``clean_name``, ``flag`` and ``category``.

    ``groups`` maps a flag to its rules. A row that two groups claim comes out once for each, in one pass over the cube.
    """
    groups = groups or {"enviro_agy": fixed.BUREAU_RULES, "benchmark_agy": fixed.BENCHMARK_RULES}
    claims = [F.struct(first_rule(rules).alias("clean_name"), F.lit(flag).alias("flag")) for flag, rules in groups.items()]
    claimed = F.filter(F.array(*claims), lambda c: c["clean_name"].isNotNull())
    rows = cube.select("*", F.inline(claimed))
    return relocate(rows.withColumn("category", group_of("clean_name", categories)), ["category"], after="clean_name")


# ---- classes ----

def job_class(
    code: str = "stemocc", tech: Iterable[str] = tuple(fixed.TECH_JOBS), analyst: Iterable[str] = tuple(fixed.ANALYST_JOBS),
    outside: Iterable[str] = tuple(fixed.NOT_STEM_CODES),
) -> Column:
    """STEM_tech, STEM_analyst, STEM_research or NOT_STEM."""
    return classify_tiers(code, outside, {"STEM_tech": tech, "STEM_analyst": analyst}, "NOT_STEM", "STEM_research")


def job_class_broad(code: str = "stemocc", outside: Iterable[str] = tuple(fixed.NOT_STEM_CODES)) -> Column:
    return classify_tiers(code, outside, {}, "NOT_STEM", "STEM")


def workforce_totals(df: DataFrame, keys: Sequence[str], measure: str = "employment", class_column: str = "job_class") -> DataFrame:
    """Headcount per class and in total, wide; a class without staff is 0. One conditional aggregate."""
    kind = F.col(class_column)
    return df.groupBy(*keys).agg(
        sum_when(kind.isin("STEM_analyst", "STEM_research"), measure).alias("STEM"),
        sum_when(kind == "STEM_tech", measure).alias("Tech"),
        sum_when(kind == "NOT_STEM", measure).alias("Not STEM"),
        sum_or_zero(measure).alias("total_employees"))


def workforce_mix(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, class): headcount and % of the workforce."""
    long = unpivot_long(totals, [*keys, "total_employees"], CLASSES)
    return long.withColumn("percent_workforce", share("value", "total_employees"))


def tech_ratio(totals: DataFrame) -> DataFrame:
    """Tech / non-tech staff and tech % of the workforce."""
    rest = F.col("STEM") + F.col("`Not STEM`")
    return totals.withColumns({"non_it": rest, "total_workforce": rest + F.col("Tech")}).withColumns({
        "ratio_tech": ratio("Tech", "non_it"), "tech_pct": share("Tech", "total_workforce")})


def tech_pct_latest(ratios: DataFrame, entity: str = "clean_name", year: str = "year") -> DataFrame:
    """Newest tech % per entity with its display rank."""
    newest = latest_per_group(ratios.select(entity, year, "tech_pct"), [entity], year, reduced=True)
    return with_order_rank(newest, entity, "tech_pct")


def headcount_change(
    df: DataFrame, keys: Sequence[str], first_year: int, last_year: int, measure: str = "employment", year: str = "year",
) -> DataFrame:
    """Headcount in two years, net and % change."""
    return period_change(df, keys, year, measure, first_year, last_year)


def department_rollup(
    df: DataFrame, department: str, bureau: str, year: str = "year", measure: str = "employment", class_column: str = "job_class",
) -> DataFrame:
    """Bureau rows and department rows in one table, mix and ratio of each; ``level`` tells them apart.

    Departments are added up from the bureau totals by grouping sets, so the staff rows are read and grouped once.
    """
    totals = workforce_totals(df, [department, bureau, year], measure, class_column)
    d, b, y = F.col(department), F.col(bureau), F.col(year)
    grouped = totals.groupingSets([[d, b, y], [d, y]], d, b, y).agg(
        F.grouping(bureau).alias("__rolled"), *[F.sum(f"`{c}`").alias(c) for c in [*CLASSES, "total_employees"]])
    rolled = F.col("__rolled") == 1
    named = grouped.select(
        d, F.when(rolled, d).otherwise(b).alias("name"), F.when(rolled, "department").otherwise("bureau").alias("level"), y,
        *CLASSES[:2], F.col("`Not STEM`"), "total_employees")
    return tech_ratio(named)


# ---- profiles ----

def supervisor_share(
    df: DataFrame, keys: Sequence[str], level: str = "supertypt", measure: str = "employment", service: str = "los",
    not_shown: str | None = "Non-Supervisor", levels: DataFrame | None = None, class_column: str = "job_class",
) -> DataFrame:
    """% of an entity's tech staff per supervisory level and their mean service.

    ``levels`` (supervis, supertypt) is joined when the rows only carry the code.
    """
    rows = df.filter(F.col(class_column) == "STEM_tech")
    if levels is not None:
        rows = enrich_star(rows, [(levels, ["supervis"])])
    by_level = rows.groupBy(*keys, level).agg(F.sum(measure).alias("employees"), F.avg(service).alias("mean_los"))
    out = with_group_total(by_level, keys, {"STEM_tech": F.sum("employees")}, reduced=True)
    out = out.withColumn("per_supervis", share("employees", "STEM_tech"))
    return out.filter(F.col(level) != not_shown) if not_shown else out


def supervisor_summary(shares: DataFrame, keys: Sequence[str], level: str = "supertypt") -> DataFrame:
    """Mean over the years."""
    return shares.groupBy(*keys, level).agg(
        F.avg("per_supervis").alias("mean_pct_emp"), F.avg("mean_los").alias("mean_los_all"))


def grade_mix(
    df: DataFrame, keys: Sequence[str], grade: str = "ppgrd", measure: str = "employment", class_column: str = "job_class",
    crosswalk: Mapping[str, Iterable[str]] = fixed.GRADE_CROSSWALK, bands: Mapping[str, Iterable[str]] = fixed.GRADE_BANDS,
) -> DataFrame:
    """Tech staff per pay band as % of all tech staff. Grades without a crosswalk count in the total only."""
    tech = df.filter(F.col(class_column) == "STEM_tech")
    by_band = tech.groupBy(*keys, crosswalk_band(grade, crosswalk, bands).alias("pay_scale_simple")).agg(
        F.sum(measure).alias("total_emp"))
    out = with_group_total(by_band, keys, {"all_IT": F.sum("total_emp")}, reduced=True)
    return out.filter(F.col("pay_scale_simple").isNotNull()).withColumn("percent", share("total_emp", "all_IT"))


def employment_trends(
    df: DataFrame, keys: Sequence[str], occupation: str = "occ", stem_code: str = "stemocc", measure: str = "employment",
    tech: Iterable[str] = tuple(fixed.TECH_TALENT_JOBS), analyst: Iterable[str] = tuple(fixed.ANALYST_JOBS),
    not_stem: Iterable[str] = ("XXXX",),
) -> DataFrame:
    """All, tech, STEM and analyst headcount and their %; four filtered sums in one aggregate."""
    occ = F.col(occupation)
    out = df.groupBy(*keys).agg(
        sum_or_zero(measure).alias("total_emp"),
        sum_when(occ.isin(list(tech)), measure).alias("total_tech"),
        sum_when(~F.col(stem_code).isin(list(not_stem)), measure).alias("total_stem"),
        sum_when(occ.isin(list(analyst)), measure).alias("total_analyst"))
    return out.withColumns({f"per_in_{part}": share(f"total_{part}", "total_emp") for part in ("tech", "stem", "analyst")})


def tech_share_all(
    df: DataFrame, entity: str, year: str = "year", occupation: str = "occ", measure: str = "employment",
    tech: Iterable[str] = tuple(fixed.TECH_TALENT_JOBS),
) -> DataFrame:
    """Tech % per (entity, year) averaged over the entity's years; a year without tech staff counts as 0 %."""
    yearly = df.groupBy(entity, year).agg(
        sum_or_zero(measure).alias("total_workforce"),
        sum_when(F.col(occupation).isin(list(tech)), measure).alias("total_tech"))
    return yearly.groupBy(entity).agg(F.avg(share("total_tech", "total_workforce")).alias("mean_tech"))


def occupation_profile(
    df: DataFrame, keys: Sequence[str], condition: Column | None = None, measure: str = "employment", salary: str = "salary",
    service: str = "los",
) -> DataFrame:
    """Headcount, mean salary and mean service per (occupation, grade, ...).

    With a condition, the same figures for the rows meeting it stand beside those of all rows (``tech_*``); groups
    without such a row are left out.
    """
    def figures(only: Column | None, prefix: str) -> list[Column]:
        pick = (lambda c: F.col(c)) if only is None else (lambda c: F.when(only, F.col(c)))
        return [F.sum(pick(measure)).alias(f"{prefix}total_employees"), exact_mean(pick(salary)).alias(f"{prefix}mean_salary"),
                F.avg(pick(service)).alias(f"{prefix}length_of_service")]

    if condition is None:
        return df.groupBy(*keys).agg(*figures(None, ""))
    both = df.groupBy(*keys).agg(*figures(None, ""), *figures(condition, "tech_"), F.max(condition).alias("__any"))
    return both.filter("__any").drop("__any")


def largest_units(
    df: DataFrame, unit: str, year: str = "year", measure: str = "employment", n: int = 15,
) -> DataFrame:
    """Units with the largest mean yearly headcount."""
    yearly = df.groupBy(unit, year).agg(sum_or_zero(measure).alias("total_emp"))
    means = yearly.groupBy(unit).agg(F.avg("total_emp").alias("mean_emp"))
    return top_n_global(means, "mean_emp", [unit], n)


def top_occupation_trends(
    df: DataFrame, occupation: str = "occt", year: str = "year", measure: str = "employment", n_rows: int = 100,
) -> DataFrame:
    """All years of every occupation that occurs among the ``n_rows`` largest (year, occupation) rows."""
    yearly = df.groupBy(year, occupation).agg(sum_or_zero(measure).alias("total_employees"))
    top = top_n_global(yearly, "total_employees", [occupation, year], n_rows)
    return keep_matching(yearly, top, [occupation])


def ratio_long(trends: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Trend measures in long form with a ``total``/``percent`` tag and the tech-to-STEM ratio."""
    measures = [c for c in trends.columns if c.startswith(("total_", "per_in_"))]
    with_ratio = trends.withColumn("ratio_tech_stem", ratio("total_tech", "total_stem"))
    numbers = with_ratio.select(*ids, "ratio_tech_stem", *[F.col(m).cast("double").alias(m) for m in measures])
    long = unpivot_long(numbers, [*ids, "ratio_tech_stem"], measures)
    kind = F.when(match_any("name", ["total"]), "total").when(match_any("name", ["per"]), "percent")
    return long.withColumn("type", kind)


def add_location(df: DataFrame, locations: DataFrame, code: str = "loc") -> DataFrame:
    """Duty location names; rows with an unknown location code are dropped."""
    return join_on(df, locations, {code: "loc"}, "inner")

