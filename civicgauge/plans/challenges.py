"""Prize challenges: tidy table, counts per agency, type and year, prize size, duration, trend."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.functions import (
    KEEP, duration_days, first_rule, group_of, match_any, parse_date, parse_money, ratio, recode, share, year_of,
)
from civicgauge.operators.aggregate import count_when, crosstab_with_totals, per_member, sum_or_zero, with_shares
from civicgauge.operators.combine import distinct_rows, union_by_name
from civicgauge.operators.project import between, clean_names, drop_members, tag
from civicgauge.operators.ranking import top_n_global
from civicgauge.operators.reshape import complete_entities, densify, split_to_columns, unpivot_long
from civicgauge.operators.stats import trend_by_group, with_scenarios
from civicgauge.plans import fixed_values as fixed

DASH = r"\s*(?:–|-)\s*"
TYPES = list(fixed.CHALLENGE_TYPES)


def challenges_tidy(
    *extracts: DataFrame, entity_rules: Sequence[tuple[str, str, str]] = tuple(fixed.CHALLENGE_ENTITY_RULES),
    flags: Mapping[str, Iterable[str]] = fixed.AGENCY_FLAGS, categories: Mapping[str, Iterable[str]] = fixed.CATEGORIES,
    types: Mapping[str, Iterable[str]] = fixed.CHALLENGE_TYPES, as_of: str | None = None,
) -> DataFrame:
    """Yearly extracts -> one clean row per challenge."""
    raw = clean_names(distinct_rows(union_by_name(*extracts)))
    named = split_to_columns(raw, "primary_agency_name", DASH, ["department", "sub_agency"])
    dated = named.withColumns({
        "start_date": parse_date("challenge_start_date"), "end_date": parse_date("challenge_end_date"),
        "prize_num": parse_money("prize_amount")})
    tidy = dated.withColumns({
        "start_year": year_of("start_date"), "end_year": year_of("end_date"),
        "duration_days": duration_days("start_date", "end_date"), "tidy_agy": first_rule(entity_rules)})
    out = tidy.withColumns({
        "env_flag": group_of("tidy_agy", flags, fixed.OTHER_AGENCY), "category": group_of("tidy_agy", categories),
        "tidy_challenge_type": group_of("primary_challenge_type", types)})
    return tag(out, date_last_data=F.lit(as_of).cast("date"))


def name_based_group(agency_name: str = "primary_agency_name", parts: Iterable[str] = tuple(fixed.ENVIRONMENTAL_NAME_PARTS)) -> Column:
    """The earlier flag: environmental when any of the name parts occurs in the agency name."""
    return F.when(match_any(agency_name, parts), fixed.ENVIRONMENTAL_GROUP).otherwise(fixed.OTHER_GROUP)


def _type_counts(types: Iterable[str], column: str = "tidy_challenge_type") -> dict[str, Column]:
    return {t: count_when(F.col(column) == t) for t in types}


def tech_per_agency_trend(
    tidy: DataFrame, first_year: int = 2016, types: Sequence[str] = TYPES, tech: str = fixed.TECH_CHALLENGE,
    not_shown: str = fixed.OTHER_AGENCY,
) -> DataFrame:
    """Per (year, flag): challenges by type, departments taking part, tech challenges per department."""
    counted = between(tidy, "start_year", first_year).filter(F.col("env_flag") != not_shown).groupBy("start_year", "env_flag").agg(
        *[c.alias(t) for t, c in _type_counts(types).items()], F.count_distinct("department").alias("env_agencies"))
    total = sum((F.col(f"`{t}`") for t in types[1:]), F.col(f"`{types[0]}`"))
    return counted.withColumns({
        "total_env_challenges": total, "tech_enviro": ratio(F.col(f"`{tech}`"), "env_agencies")})


def agency_breakdown(
    tidy: DataFrame, first_year: int = 2016, last_year: int = 2025, types: Sequence[str] = TYPES, tech: str = fixed.TECH_CHALLENGE,
    not_shown: str = fixed.OTHER_AGENCY,
) -> DataFrame:
    """Per entity: typed challenges, tech challenges, tech share."""
    rows = between(tidy, "start_year", first_year, last_year).filter(F.col("env_flag") != not_shown)
    return rows.groupBy("tidy_agy", "env_flag", "category").agg(*_totals(types, tech)).withColumn(
        "tech_nontech_chal", ratio("total_tech_challenges", "total_challenges"))


def _totals(types: Sequence[str], tech: str) -> list[Column]:
    kind = F.col("tidy_challenge_type")
    return [count_when(kind.isin(list(types))).alias("total_challenges"), count_when(kind == tech).alias("total_tech_challenges")]


def entity_totals(
    tidy: DataFrame, entities: DataFrame, first_year: int = 2016, last_year: int = 2025, tech: str = fixed.TECH_CHALLENGE,
) -> DataFrame:
    """All and tech challenges for every entity of the list, 0 where it has none."""
    counted = between(tidy, "start_year", first_year, last_year).groupBy("tidy_agy").agg(
        F.count(F.lit(1)).alias("total_challenges"), count_when(F.col("tidy_challenge_type") == tech).alias("tech_chal"))
    return complete_entities(counted, entities, ["tidy_agy"], {"total_challenges": 0, "tech_chal": 0})


def flag_breakdown(
    tidy: DataFrame, first_year: int = 2016, last_year: int = 2025, types: Sequence[str] = TYPES, tech: str = fixed.TECH_CHALLENGE,
    not_shown: str = fixed.OTHER_AGENCY,
) -> DataFrame:
    """Per flag: distinct members, totals, tech share, averages per member.

    A member is the short entity, or the raw agency name where there is none.
    """
    member = F.when(F.col("env_flag") != not_shown, F.col("tidy_agy")).otherwise(F.col("primary_agency_name"))
    rows = between(tidy, "start_year", first_year, last_year).withColumn("__member", member)
    totals = rows.groupBy("env_flag").agg(F.count_distinct("__member").alias("unique_agencies"), *_totals(types, tech))
    return totals.withColumns({
        "tech_nontech_chal": ratio("total_tech_challenges", "total_challenges"),
        "average_total_chal": ratio("total_challenges", "unique_agencies"),
        "average_tech_chal": ratio("total_tech_challenges", "unique_agencies")})


def type_by_year_normalised(
    summary: DataFrame, measure: str | None = "total_challenges", types: Mapping[str, Iterable[str]] = fixed.YEARLY_CHALLENGE_TYPES,
    first_year: int = 2016, before_year: int = 2025, drop_types: Iterable[str] = (), per_type_members: bool = False,
) -> DataFrame:
    """Per (group, type, year): challenges / departments active in the group that year (or in that type, if asked)."""
    rows = between(summary, "start_year", first_year, before_year, open_end=True)
    rows = drop_members(rows, "primary_challenge_type", drop_types).withColumn(
        "primary_challenge_type", recode("primary_challenge_type", types, KEEP))
    keys = ["env_flag", "primary_challenge_type", "start_year"]
    return per_member(
        rows, keys, keys if per_type_members else ["env_flag", "start_year"], "department", measure, "total_challenges",
        "total_agencies", "chal_per_agency")


def total_by_year_normalised(
    summary: DataFrame, measure: str | None = "total_challenges", first_year: int = 2016, before_year: int = 2025,
    tags: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per (group, year): challenges / active departments, with the group's tag."""
    rows = between(summary, "start_year", first_year, before_year, open_end=True)
    keys = ["env_flag", "start_year"]
    out = per_member(rows, keys, keys, "department", measure, "total_challenges", "total_agencies", "chal_per_agency")
    names = tags or {fixed.ENVIRONMENTAL_GROUP: "environmental", fixed.OTHER_GROUP: "other"}
    return out.withColumn("tag", recode("env_flag", {new: [old] for old, new in names.items()}, KEEP))


def member_totals(summary: DataFrame, measure: str | None = "total_challenges") -> DataFrame:
    cell = F.lit(1) if measure is None else F.col(measure)
    return summary.groupBy("department", "env_flag").agg(sum_or_zero(cell).alias("total_challenges"))


def member_type_dense(
    summary: DataFrame, types: Sequence[str], measure: str | None = "total_challenges",
    groups: Mapping[str, Iterable[str]] = fixed.YEARLY_CHALLENGE_TYPES,
) -> DataFrame:
    """Department x type with zeros."""
    rows = summary.select(
        "department", "env_flag", recode("primary_challenge_type", groups, KEEP).alias("primary_challenge_type"),
        (F.lit(1) if measure is None else F.col(measure)).alias("tech_challenges"))
    return densify(rows, ["department", "env_flag"], "primary_challenge_type", types, "tech_challenges")


def prize_duration_stats(tidy: DataFrame, long: bool = False) -> DataFrame:
    """Mean prize and mean duration per (group, year)."""
    out = tidy.groupBy("env_flag", "start_year").agg(
        F.avg("duration_days").alias("mean_duration_days"), F.avg("prize_num").alias("mean_prize"))
    return unpivot_long(out, ["env_flag", "start_year"], ["mean_duration_days", "mean_prize"]) if long else out


def no_prize_share(tidy: DataFrame) -> DataFrame:
    """Challenges without prize money and their % per group."""
    counted = tidy.groupBy("env_flag").agg(
        count_when(F.col("prize_num") == 0).alias("no_prize"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("percentage", share("no_prize", "total"))


def no_prize_gap(tidy: DataFrame, group: str, other: str) -> DataFrame:
    """One row: no-prize % of one group minus that of another."""
    def percent(g: str) -> Column:
        mine = F.col("env_flag") == g
        return share(count_when(mine & (F.col("prize_num") == 0)), count_when(mine))

    return tidy.agg((percent(group) - percent(other)).alias("percent_gap"))


def challenge_trends(
    tidy: DataFrame, by: Sequence[str] = ("env_flag",), per_agency: bool = False, measure: str | None = None,
    exclude: Iterable[str] | None = None,
) -> DataFrame:
    """Least squares of yearly counts (or counts per department) on the year, per group.

    With ``exclude`` the fit is repeated without the named departments, in the same pass: column ``scenario``.
    """
    keys = [*by, "start_year"]
    cell = F.lit(1) if measure is None else F.col(measure)
    reduced = tidy.groupBy(*keys, "department").agg(sum_or_zero(cell).alias("n"))
    if exclude is not None:
        reduced = with_scenarios(reduced, "department", exclude)
        keys = ["scenario", *keys]
    yearly = reduced.groupBy(*keys).agg(
        sum_or_zero("n").alias("n_challenges"), F.count_distinct("department").alias("n_agencies"))
    yearly = yearly.withColumn("per_agency", ratio("n_challenges", "n_agencies"))
    return trend_by_group(yearly, keys[:-1], "start_year", "per_agency" if per_agency else "n_challenges")


def type_share_crosstab(tidy: DataFrame, types: Sequence[str], column: str = "primary_challenge_type") -> DataFrame:
    """Year x flag rows with each type's share of the row, and an ``All`` row."""
    counts = crosstab_with_totals(tidy, ["start_year", "env_flag"], column, types)
    return with_shares(counts, [*types, "All"], "All", 1.0)


def participation(tidy: DataFrame) -> DataFrame:
    """Departments and challenges per (year, group), long."""
    out = tidy.groupBy("start_year", "env_flag").agg(
        F.count_distinct("department").alias("Agencies"), F.count(F.lit(1)).alias("Challenges"))
    return unpivot_long(out, ["start_year", "env_flag"], ["Agencies", "Challenges"])


def top_departments(tidy: DataFrame, n: int = 20, keys: Sequence[str] = ("env_flag", "department"), also: Column | None = None) -> DataFrame:
    """The departments with most challenges, plus the rows that meet ``also``."""
    counted = tidy.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return top_n_global(counted, "count", list(keys), n, also)

