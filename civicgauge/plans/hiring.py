"""Job postings: tidy table, keyword hits, IT share over time, top series, estimated openings, scored texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.functions import (
    annualise, bin_to, bool_flag, duration_days, excess_over_one, expand_abbreviations, first_rule, group_of, has_text, hit_flags,
    join_items, keep_characters, label_codes, make_key, match_any, normalise_bool, parse_date, parse_object, quarter_label, ratio,
    recode, row_sum, share, title_case, to_number, word_weight, year_of,
)
from civicgauge.operators.aggregate import (
    count_and_sums, count_by, count_when, mean_of_ratios, sum_or_zero, with_shares,
)
from civicgauge.operators.incremental import consolidate_hits, enrich_unique
from civicgauge.operators.joins import join_on, lookup, with_group_total, with_scalar
from civicgauge.operators.project import between, drop_members, keep_members_of_any, relocate, tag
from civicgauge.operators.ranking import latest_per_group, top_n_per_group
from civicgauge.operators.reshape import (
    consolidate_children, consolidate_children_across, explode_delimited, pivot_wide, unnest, unpivot_long,
)
from civicgauge.plans import fixed_values as fixed
from civicgauge.session import durable

FLAGS = list(fixed.KEYWORDS)


# ---- tidy tables ----

def postings_consolidated(pulls: DataFrame, key: str = "id", term: str = "keyword", volatile: Sequence[str] = ("page",)) -> DataFrame:
    """One row per posting with all search keywords that found it."""
    return consolidate_hits(pulls, [key], term, volatile=volatile)


def postings_tidy(
    postings: DataFrame, keywords: Mapping[str, str] = fixed.KEYWORDS, labels: Mapping[str, str] = fixed.MISSION_CRITICAL_LABELS,
    unique_ids: bool = False,
) -> DataFrame:
    """Flat postings: dates, days open, title-cased names, series, paths, tags, keyword flags, pay range, duties.

    One row per posting, grade and pay range. Children of postings with the same id and names are listed together; where
    ``unique_ids`` promises one row per id, this happens within the row and nothing is shuffled. Postings without a
    series, a hiring path, a pay range or any keyword flag are left out.
    """
    names = {c: title_case(c) for c in ("agency", "subagency", "position", "openings")}
    dated = postings.withColumns({
        "date_posted": parse_date("date_posted"), "date_closes": parse_date("date_closes"), **names})
    dated = dated.withColumn("days_open", duration_days("date_posted", "date_closes"))
    keys = ["id", "agency", "subagency", "position"]
    series = {"all_series": ("series", "Name"), "all_series_code": ("series", "Code")}
    paths = {"hiring_paths": ("hiring_path", None), "all_mco_tags": ("mco_tags", None)}
    if unique_ids:
        merged = consolidate_children(dated, {**series, **paths}, drop=False)
    else:
        merged = consolidate_children_across(dated, keys, series, more_keys=["date_posted", "date_closes"], more_lists=paths)
    merged = merged.filter(F.col("all_series_code").isNotNull() & F.col("hiring_paths").isNotNull())
    flagged = merged.withColumns({
        **hit_flags("all_keywords", keywords), "subagency": expand_abbreviations("subagency", {"U.s.": "U.S."}),
        "mco_tags_tidy": label_codes("all_mco_tags", labels), "tidy_duties": make_key(
            "id", join_items("major_duties", ". "), separator=" ")})
    counted = flagged.withColumn("total_keywords", row_sum(keywords)).filter(F.col("total_keywords") != 0)
    graded = unnest(counted, "grade_type", prefix="grade_type_")
    paid = unnest(graded, "salary_rage")
    renamed = paid.withColumnsRenamed({
        "grade_type_Code": "grade_type_code", "MinimumRange": "minimum_range", "MaximumRange": "maximum_range",
        "Description": "description"})
    return relocate(renamed.drop("RateIntervalCode", "series", "hiring_path", "mco_tags"), ["mco_tags_tidy"], "all_mco_tags")


def postings_summary(
    tidy: DataFrame, entity_rules: Sequence[tuple[str, str, str]] = tuple(fixed.POSTING_ENTITY_RULES),
    categories: Mapping[str, Iterable[str]] = fixed.CATEGORIES, it_series: Iterable[str] = tuple(fixed.IT_SERIES),
    groups: Mapping[str, Mapping[str, Iterable[str]]] | None = None, date_last_data: object = None,
) -> DataFrame:
    """Entity, category, yearly pay, IT flag and provenance for the postings of the chosen agencies.

    ``groups`` maps an analysis flag to ``{column: members}``; a posting that two groups claim comes out once for each.
    """
    groups = groups or {
        "enviro_agy": {"subagency": fixed.ENVIRONMENTAL_SUBAGENCIES},
        "benchmark_agy": {"subagency": fixed.BENCHMARK_SUBAGENCIES, "agency": fixed.BENCHMARK_AGENCIES}}
    claimed = F.array_compact(F.array(*[F.when(_on_any_list(lists), F.lit(flag)) for flag, lists in groups.items()]))
    rows = tidy.withColumn("analysis_flag", F.explode(claimed))
    out = rows.withColumns({
        "min_annual_salary": annualise("minimum_range", "description"),
        "it_specialist": match_any("all_series_code", it_series), "openings": F.col("openings").cast("string"),
        "clean_name": first_rule(entity_rules)}).withColumn("category", group_of("clean_name", categories))
    return tag(out.select(
        "id", "subagency", "clean_name", "category", "position", "min_annual_salary", "openings", "all_series_code", "all_series",
        "it_specialist", "analysis_flag"), date_last_data=date_last_data)


def _on_any_list(lists: Mapping[str, Iterable[str]]) -> Column:
    test = F.lit(False)
    for column, members in lists.items():
        test = test | F.coalesce(F.col(column).isin(list(members)), F.lit(False))
    return test


def postings_of(tidy: DataFrame, **lists: Iterable[str]) -> DataFrame:
    """Postings with at least one column on its list."""
    return keep_members_of_any(tidy, lists)


def children_consolidated(history: DataFrame, key: str = "usajobs_control_number") -> DataFrame:
    """Series, places and hiring paths of each announcement as text, over all rows of its control number; no row is lost."""
    lists = {
        "job_series": ("job_categories", "series"), "job_city": ("position_locations", "positionLocationCity"),
        "job_state": ("position_locations", "positionLocationState"),
        "job_country": ("position_locations", "positionLocationCountry"), "hiring_paths_all": ("hiring_paths", "hiringPath")}
    return consolidate_children_across(history, [key], lists).drop(*{array for array, _ in lists.values()})


def history_tidy(history: DataFrame, it_series: Iterable[str] = tuple(fixed.IT_SERIES)) -> DataFrame:
    """Announcement history with clean dates, year, IT flag and a unique id."""
    codes = F.transform(F.col("job_categories"), lambda c: c["series"])
    return history.withColumns({
        "open_date_clean": parse_date("position_open_date"), "close_date_clean": parse_date("position_close_date"),
        "exp_date_clean": parse_date("position_expire_date"),
        "it_flag": F.when(F.arrays_overlap(codes, F.array(*map(F.lit, it_series))), "IT").otherwise("not_IT"),
        "unique_id": make_key("usajobs_control_number", "announcement_number", separator="--"),
    }).withColumn("open_year", year_of("open_date_clean"))


# ---- keywords ----

def keyword_hits(df: DataFrame, entity: str = "subagency", flags: Sequence[str] = FLAGS, exclude: Iterable[str] = ()) -> DataFrame:
    """Per entity: announcements, hits per keyword, % per keyword."""
    shown = [f for f in flags if f not in set(exclude)]
    return with_shares(count_and_sums(df, [entity], shown), shown, "total_announcements", suffix="_pct")


def keyword_hits_long(df: DataFrame, entity: str = "subagency", flags: Sequence[str] = FLAGS, exclude: Iterable[str] = ()) -> DataFrame:
    """Per (entity, keyword): % of announcements."""
    shown = [f for f in flags if f not in set(exclude)]
    return _percent_long(df, [entity], shown)


def _percent_long(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    wide = with_shares(count_and_sums(df, keys, flags), flags, "total_announcements")
    return unpivot_long(wide, [*keys, "total_announcements"], flags)


def _mission_critical(tags: str) -> Column:
    return F.when(has_text(tags), "MCO").otherwise("Not MCO")


def mission_critical_share(df: DataFrame, entity: str = "subagency", tags: str = "all_mco_tags") -> DataFrame:
    """Mission-critical and other announcements per entity, and the %."""
    wide = pivot_wide(df.withColumn("is_mco", _mission_critical(tags)), [entity], "is_mco", ["MCO", "Not MCO"])
    return wide.withColumn("percent_mco", share("MCO", F.col("MCO") + F.col("`Not MCO`")))


def mission_critical_keywords(
    df: DataFrame, entity: str = "subagency", tags: str = "all_mco_tags", flags: Sequence[str] = FLAGS,
) -> DataFrame:
    """Keyword % inside mission-critical and other announcements."""
    return _percent_long(df.withColumn("is_mco", _mission_critical(tags)), [entity, "is_mco"], flags)


def keyword_count_distribution(df: DataFrame, entity: str = "subagency", column: str = "total_keywords") -> DataFrame:
    """% of an entity's announcements by number of keywords matched."""
    return _share_of_entity(count_by(df, [entity, column], "total_jobs_matched"), entity, "total_jobs_matched",
                            "total_announcements", "pct_keywords")


def _share_of_entity(counted: DataFrame, entity: str, count: str, total: str, result: str) -> DataFrame:
    return with_group_total(counted, [entity], {total: F.sum(count)}, reduced=True).withColumn(result, share(count, total))


def salary_band_keywords(
    df: DataFrame, entity: str = "subagency", salary: str = "min_annual_salary", width: int = 10_000, flags: Sequence[str] = FLAGS,
) -> DataFrame:
    """Keyword % per entity and pay bin."""
    return _percent_long(df.withColumn(f"{salary}_bin", bin_to(salary, width)), [entity, f"{salary}_bin"], flags)


def focus_postings(
    df: DataFrame, entity: str = "subagency", flags: Sequence[str] = tuple(fixed.FOCUS_KEYWORDS), tags: str = "mco_tags_tidy",
) -> DataFrame:
    """Per entity: all jobs, jobs with any of the focus keywords, how many of these are mission critical, hits of each."""
    hit = row_sum(flags) > 0
    out = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("total_jobs"), count_when(hit).alias("focus_jobs"),
        count_when(hit & has_text(tags)).alias("focus_mco"), *[sum_or_zero(f).alias(f"total_{f}") for f in flags])
    return out.filter(F.col("focus_jobs") > 0)


# ---- series ----

def top_series(
    summary: DataFrame, n: int = 5, keys: Sequence[str] = ("clean_name", "analysis_flag"), unnamed: str = fixed.UNNAMED_SERIES,
    short_names: Mapping[str, Iterable[str]] = fixed.SERIES_SHORT_NAMES, it_name: str = "IT Management",
) -> DataFrame:
    """The n most frequent job series per entity. Names come from the postings that carry a single code."""
    counted = count_by(
        explode_delimited(summary.select(*keys, "all_series_code"), "all_series_code", into="value"), [*keys, "value"], "totals")
    top = top_n_per_group(counted, keys, "totals", ["value"], n)
    # One name for each code: the most usual one, of equally usual ones the first.
    single = count_by(summary.filter((F.length("all_series_code") == 4) & F.col("all_series").isNotNull()), ["all_series_code", "all_series"], "__n")
    names = single.groupBy("all_series_code").agg(F.min_by("all_series", F.struct(-F.col("__n"), F.col("all_series"))).alias("all_series"))
    named = join_on(top.drop("all_series_code"), names, {"value": "all_series_code"}, "left")
    named = named.withColumn("all_series", recode(F.coalesce(F.col("all_series"), F.lit(unnamed)), short_names))
    is_it = F.col("all_series") == it_name
    return named.withColumns({
        "IT_flag": F.when(is_it, "IT").otherwise("Not IT"), "num_it": F.when(is_it, F.col("totals")).otherwise(0)})


# ---- IT share over time ----

def it_share_by_period(
    df: DataFrame, keys: Sequence[str] = ("clean_name", "type", "category"), day: str = "open_date_clean", by: str = "year",
    first_year: int | None = 2020, last_year: int | None = 2025, skip: Iterable[str] = ("2025 Q3", "2025 Q4"),
    skip_for: Mapping[str, Iterable[str]] | None = None, is_it: Column | None = None,
) -> DataFrame:
    """Announcements, IT announcements and % IT per entity and year (or quarter).

    Unfinished quarters in ``skip`` are left out; ``skip_for`` names more of them for single entities.
    """
    rows = between(df.withColumns({"__year": year_of(day), "__quarter": quarter_label(day)}), "__year", first_year, last_year)
    rows = drop_members(rows, "__quarter", skip)
    for entity, quarters in (skip_for or {}).items():
        out = (F.col(keys[0]) == entity) & F.col("__quarter").isin(list(quarters))
        rows = rows.filter(~F.coalesce(out, F.lit(False)))
    period = F.col("__year") if by == "year" else F.col("__quarter")
    it = F.col("it_flag") == "IT" if is_it is None else is_it
    out = rows.groupBy(*keys, period.alias("period")).agg(
        F.count(F.lit(1)).alias("announcements"), count_when(it).alias("num_it"))
    return out.withColumn("pct_it", share("num_it", "announcements"))


def it_share_latest(by_year: DataFrame, entity: Sequence[str] = ("clean_name",)) -> DataFrame:
    """The newest year of each entity."""
    return latest_per_group(by_year, entity, "period", reduced=True)


def it_posting_totals(summary: DataFrame, entity: str = "clean_name") -> DataFrame:
    return summary.groupBy(entity).agg(F.count(F.lit(1)).alias("total"), count_when(F.col("it_specialist")).alias("it_postings"))


# ---- openings ----

def openings_estimate(
    df: DataFrame, entity: str = "subagency", openings: str = "openings", words: Mapping[str, int] = fixed.OPENING_WORDS,
    null_weight: int | None = None, key: str = "id",
) -> DataFrame:
    """Rows, least number of openings they stand for, and the difference, per entity.

    Rows without an openings value are left out unless ``null_weight`` says how many to count for them.
    """
    weight = word_weight(openings, words, null_weight)
    rows = df.filter(F.col(entity).isNotNull())
    rows = rows if null_weight is not None else rows.filter(F.col(openings).isNotNull())
    out = rows.groupBy(entity).agg(F.count(key).alias("row_count"), sum_or_zero(weight).alias("estimate"))
    return out.withColumn("estimated_undercount", F.col("estimate") - F.col("row_count"))


def hiring_core_stats(
    scored: DataFrame, workforce: DataFrame, entities: Iterable[str] | None = tuple(fixed.ENVIRONMENTAL_SUBAGENCIES),
    words: Mapping[str, int] = fixed.OPENING_WORDS, above: float = 5, year: int | None = 2024, entity: str = "subagency",
) -> DataFrame:
    """Per entity: listings, tech listings and their ratio to the workforce, process / AI / STEM counts, best score, high
    scorers, their undercounted openings, and the tech listings expected at the mean ratio of all entities."""
    rows = scored if entities is None else scored.filter(F.col(entity).isin(list(entities)))
    high = F.coalesce(F.col("innovative_score") > above, F.lit(False))
    weight = word_weight("openings", words, null_weight=1)
    def flag(column: str) -> Column:
        return sum_or_zero(F.col(column).cast("int"))

    stats = rows.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count(F.when(F.col("openings").isNotNull(), F.col("id"))).alias("num_listings"), flag("it_specialist").alias("num_tech"),
        (flag("user_research") + flag("agile_startup_ux")).alias("num_inno_processes"), flag("use_ai").alias("num_ai"),
        flag("stem_job").alias("num_stem"), F.max("innovative_score").cast("bigint").alias("inno_max"),
        count_when(high).alias("inno_tendency"), excess_over_one(weight, high).alias("inno_undercount"))
    staff = workforce if year is None else workforce.filter(F.col("year") == year)
    staff = staff.select(recode("name", fixed.WORKFORCE_NAME_FIXES).alias("name"), "total_workforce")
    stats = lookup(stats, staff, entity, "name", "total_workforce")
    stats = stats.withColumn("tech_wf_ratio", ratio("num_tech", "total_workforce"))
    stats = durable(stats, "core-stats")  # one row per entity; without this the mean would read all postings again
    mean = mean_of_ratios(stats, "num_tech", "num_listings")
    return with_scalar(stats, "__mean", mean).withColumn(
        "expected_tech", F.col("num_listings") * F.col("__mean")).drop("__mean", "total_workforce")


# ---- scored texts ----

def score_duties(
    postings: DataFrame, score: Callable[[pd.Series], pd.DataFrame], result: T.StructType | str = "gpt_desc string",
    duties: str = "tidy_duties_noid",
) -> DataFrame:
    """Score each distinct duty text once with the given function and give every posting its score."""
    return enrich_unique(postings, duties, score, result)


def parse_scored_text(df: DataFrame, text: str = "gpt_desc", schema: str = fixed.SCORE_FIELDS, flags: Sequence[str] = tuple(fixed.SCORE_FLAGS)) -> DataFrame:
    """Model output text -> typed columns, whatever the order of its keys."""
    parsed = df.withColumn("__o", parse_object(text, schema)).select("*", "__o.*").drop("__o", text)
    numbers = [c for c in ("similar_to_data_steward", "innovative_score") if c in parsed.columns]
    return parsed.withColumns({
        **{f: normalise_bool(f) for f in flags if f in parsed.columns}, **{n: to_number(n) for n in numbers}})


def score_distribution(df: DataFrame, entity: str = "subagency", score: str = "innovative_score") -> DataFrame:
    """% of an entity's announcements per score."""
    return _share_of_entity(count_by(df, [entity, score], "total_announcements"), entity, "total_announcements",
                            "total_announcements_posted", "pct_jobs")


def mean_score(df: DataFrame, entity: str = "subagency", score: str = "innovative_score", name: str = "mean_innov_score") -> DataFrame:
    return df.groupBy(entity).agg(F.avg(score).alias(name))


def high_scores(df: DataFrame, score: str = "innovative_score", least: float = 6) -> DataFrame:
    return between(df, score, least)


def flag_means(df: DataFrame, entity: str = "subagency", flags: Sequence[str] = tuple(fixed.SCORE_FLAGS)) -> DataFrame:
    """Mean of each boolean flag per entity, wide; nulls are not counted."""
    return df.groupBy(entity).agg(*[F.avg(bool_flag(f)).alias(f"{f}_flag") for f in flags])


def required_languages(df: DataFrame, entity: str = "subagency", column: str = "programming_types") -> DataFrame:
    """Cleaned language lists per entity with counts, ``none`` removed."""
    plain = keep_characters(column, "A-Za-z0-9 .+/#,")
    cleaned = df.withColumn(column, F.when(F.lower(plain) == "none", "none").otherwise(plain))
    return count_by(cleaned, [entity, column], "total_announcements").filter(F.col(column) != "none")
