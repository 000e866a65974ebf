"""The jobs on small invented rows in the shape of the published inputs, with the usual code lists."""

import re
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicgauge.plans import challenges, hiring, opensource, staffing, summary
from civicgauge.sources.readers import literal_table


# ---- challenges ----

@pytest.fixture(scope="module")
def tidy(spark):
    names = ["Challenge ID", "Primary Agency Name", "Challenge Start Date", "Challenge End Date", "Prize Amount", "Primary Challenge Type"]
    schema = ", ".join(f"`{n}` string" for n in names)
    first = spark.createDataFrame([
        ("1", "Environmental Protection Agency - Office of Water", "2020-01-05T00:00:00", "2020-02-04T00:00:00", "$1,000.50", "Software and apps"),
        ("2", "Department of the Interior – Bureau of Reclamation", "2020-03-01", "2020-03-02", "No monetary prize for this challenge", "Ideas"),
        ("3", "Department of Defense", "2021-06-01", None, "junk", "Unheard of"),
    ], schema)
    second = spark.createDataFrame([
        ("3", "Department of Defense", "2021-06-01", None, "junk", "Unheard of", "http://x"),
        ("1", "Environmental Protection Agency - Office of Water", "2020-01-05T00:00:00", "2020-02-04T00:00:00", "$1,000.50", "Software and apps", None),
        ("4", "National Aeronautics and Space Administration", "2021-01-01", "2021-01-11", "500", "Scientific", None),
    ], schema + ", URL string")
    return challenges.challenges_tidy(first, second, as_of="2025-06-23").cache()


def test_challenges_tidy(tidy, rows):
    out = rows(tidy.dropDuplicates(["challenge_id"]), "challenge_id", "department", "sub_agency", "start_year", "duration_days", "prize_num", "tidy_agy",
               "env_flag", "category", "tidy_challenge_type")
    assert out == [
        ("1", "Environmental Protection Agency", "Office of Water", 2020, 30, 1000.0, "EPA", "Environmental Agency", "Regulatory", "Analysis, Tech Software"),
        ("2", "Department of the Interior", "Bureau of Reclamation", 2020, 1, 0.0, "BOR", "Environmental Agency", "Field", "Ideas, Plans, Nominations"),
        ("3", "Department of Defense", None, 2021, None, None, None, "Other Agency", None, None),
        ("4", "National Aeronautics and Space Administration", None, 2021, 10, 500.0, "NASA", "Benchmark Agency", "Research", "Scientific"),
    ]
    assert tidy.count() == 5  # the copy of 1 is gone; 3 differs in a column only one extract has
    assert {r.date_last_data for r in tidy.collect()} == {date(2025, 6, 23)}


def test_challenge_indicators(tidy, spark, rows):
    trend = challenges.tech_per_agency_trend(tidy, 2016)
    assert rows(trend, "start_year", "env_flag", "env_agencies", "tech_enviro") == [
        (2020, "Environmental Agency", 2, 0.5), (2021, "Benchmark Agency", 1, 0.0)]
    assert rows(challenges.agency_breakdown(tidy), "tidy_agy", "total_challenges", "total_tech_challenges", "tech_nontech_chal") == [
        ("BOR", 1, 0, 0.0), ("EPA", 1, 1, 1.0), ("NASA", 1, 0, 0.0)]
    entities = literal_table(spark, [("EPA",), ("USFS",)], "tidy_agy string")
    assert rows(challenges.entity_totals(tidy, entities)) == [("EPA", 1, 1), ("USFS", 0, 0)]
    flags = {r[0]: tuple(r)[1:] for r in rows(challenges.flag_breakdown(tidy), "env_flag", "unique_agencies", "total_challenges", "tech_nontech_chal")}
    assert flags == {"Environmental Agency": (2, 2, 0.5), "Benchmark Agency": (1, 1, 0.0), "Other Agency": (1, 0, None)}
    assert rows(challenges.no_prize_share(tidy), "env_flag", "no_prize", "total") == [
        ("Benchmark Agency", 0, 1), ("Environmental Agency", 1, 2), ("Other Agency", 0, 2)]
    named = tidy.select(challenges.name_based_group().alias("g")).distinct()
    assert rows(named) == [("All Other Agencies",), ("Environmental / Natural Resource Agencies",)]


def test_yearly_summary_jobs(spark, rows):
    data = [(2015, "A", "e", "Ideas", 9), (2016, "A", "e", "Ideas", 2), (2016, "B", "e", "Business plans", 4), (2016, "C", "o", "Scientific", 1), (2025, "A", "e", "Ideas", 9)]
    yearly = spark.createDataFrame(data, "start_year int, department string, env_flag string, primary_challenge_type string, total_challenges bigint")
    out = challenges.type_by_year_normalised(yearly)
    assert rows(out, "env_flag", "primary_challenge_type", "total_challenges", "total_agencies", "chal_per_agency") == [
        ("e", "Ideas, Plans, Nominations", 6, 2, 3.0), ("o", "Scientific", 1, 1, 1.0)]
    total = challenges.total_by_year_normalised(yearly, tags={"e": "environmental", "o": "other"})
    assert rows(total, "tag", "chal_per_agency") == [("environmental", 3.0), ("other", 1.0)]
    dense = challenges.member_type_dense(yearly.filter("start_year = 2016"), ["Ideas, Plans, Nominations", "Scientific"])
    assert rows(dense, "department", "primary_challenge_type", "tech_challenges")[:2] == [("A", "Ideas, Plans, Nominations", 2), ("A", "Scientific", 0)]


# ---- staffing ----

FACT = "AGYSUB string, LOC string, AGELVL string, EDLVL string, GSEGRD string, LOSLVL string, OCC string, PATCO string, PPGRD string, " \
       "SALLVL string, STEMOCC string, SUPERVIS string, TOA string, WORKSCH string, WORKSTAT string, DATECODE string, EMPLOYMENT string, " \
       "SALARY string, LOS string"
OCCUPATION = "OCCTYP string, OCCTYPT string, OCCFAM string, OCCFAMT string, OCC string, OCCT string"
AGENCY = "AGYTYP string, AGYTYPT string, AGY string, AGYT string, AGYSUB string, AGYSUBT string"


def fact_line(agysub, occ, ppgrd, stem, supervis, employment):
    return f"{agysub},01,A,04,12,B,{occ},1,{ppgrd},C,{stem},{supervis},10,F,1,202303,{employment},50000,7.5"


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cube")
    for year, tech in (("2023", 3), ("2024", 6)):
        folder = root / f"FedScope_Employment_Cube_March{year}"
        folder.mkdir()
        lines = [
            fact_line("AG11", "2210", "GS-12", "2210", "2", tech), fact_line("AG11", "2210", "ZP-02", "2210", "8", 1),
            fact_line("AG11", "0301", "AD-00", "XXXX", "8", 4), fact_line("AG11", "1530", "GS-09", "1530", "8", 2),
            fact_line("NN10", "0801", "GS-13", "0801", "8", 5), fact_line("ZZ99", "9999", "GS-13", "****", "8", 7)]
        header = FACT.replace(" string", "").replace(" ", "")
        (folder / f"FACTDATA_MAR{year}.TXT").write_text("\n".join([header, *lines]))
        (folder / "DTocc.txt").write_text("\n".join([
            OCCUPATION.replace(" string", "").replace(" ", ""), "1,White,22,IT,2210,\"2210-IT, MANAGEMENT\"", "1,White,03,Admin,301,0301-ADMIN",
            "1,White,15,Math,1530,1530-STATISTICS", "1,White,08,Eng,801,0801-ENGINEERING"]))
        (folder / "DTagy.txt").write_text("\n".join([
            AGENCY.replace(" string", "").replace(" ", ""), "1,Cabinet,AG,AG-DEPARTMENT OF AGRICULTURE,AG11,AG11-FOREST SERVICE",
            "2,Large,NN,NN-NATIONAL AERONAUTICS AND SPACE ADMINISTRATION,NN10,NN10-HEADQUARTERS"]))
        (folder / "DTloslvl.txt").write_text("LOSLVL,LOSLVLT\nB,1 - 2 years\n")
    (root / "FedScope_Employment_Cube_March2024" / "FACTDATA_SEP2024.TXT").write_text(
        FACT.replace(" string", "").replace(" ", "") + "\n" + fact_line("AG11", "2210", "GS-12", "2210", "2", 1000))
    cube = staffing.read_cube(
        spark, str(root), FACT, OCCUPATION, AGENCY, "LOSLVL string, LOSLVLT string", prefer={2024: "FACTDATA_MAR2024.TXT"})
    return staffing.with_measures(cube).cache()


def test_cube(cube, rows):
    assert cube.columns == staffing.CUBE_COLUMNS and cube.count() == 12
    assert rows(cube.filter("year = 2023"), "occ", "occt", "agysubt", "loslvlt", "employment") == [
        ("0301", "0301-ADMIN", "AG11-FOREST SERVICE", "1 - 2 years", 4.0), ("0801", "0801-ENGINEERING", "NN10-HEADQUARTERS", "1 - 2 years", 5.0),
        ("1530", "1530-STATISTICS", "AG11-FOREST SERVICE", "1 - 2 years", 2.0), ("2210", "2210-IT, MANAGEMENT", "AG11-FOREST SERVICE", "1 - 2 years", 1.0),
        ("2210", "2210-IT, MANAGEMENT", "AG11-FOREST SERVICE", "1 - 2 years", 3.0), ("9999", None, None, "1 - 2 years", 7.0)]


def test_staffing_indicators(cube, spark, rows):
    people = staffing.workforce_entities(cube).withColumn("job_class", staffing.job_class())
    keys = ["clean_name", "year", "flag"]
    totals = staffing.workforce_totals(people, keys)
    assert rows(totals) == [
        ("NASA", 2023, "benchmark_agy", 5.0, 0.0, 0.0, 5.0), ("NASA", 2024, "benchmark_agy", 5.0, 0.0, 0.0, 5.0),
        ("USFS", 2023, "enviro_agy", 2.0, 4.0, 4.0, 10.0), ("USFS", 2024, "enviro_agy", 2.0, 7.0, 4.0, 13.0)]
    mix = staffing.workforce_mix(totals, keys).groupBy("clean_name", "year").agg(F.sum("percent_workforce").alias("p"))
    assert all(abs(r.p - 100) < 1e-9 for r in mix.collect())
    ratios = staffing.tech_ratio(totals)
    assert rows(ratios.filter("year = 2023"), "clean_name", "ratio_tech", "tech_pct") == [("NASA", 0.0, 0.0), ("USFS", 4 / 6, 40.0)]
    assert rows(staffing.tech_pct_latest(ratios), "clean_name", "year", "sort_rank") == [("NASA", 2024, 2), ("USFS", 2024, 1)]
    assert rows(staffing.headcount_change(people, ["clean_name"], 2023, 2024), "clean_name", "net_change", "pct_change") == [
        ("NASA", 0.0, 0.0), ("USFS", 3.0, 30.0)]
    grades = staffing.grade_mix(people, ["clean_name", "year"])
    assert rows(grades.filter("year = 2023"), "pay_scale_simple", "total_emp", "percent") == [("GS 04-09", 1.0, 25.0), ("GS 11-15", 3.0, 75.0)]
    levels = literal_table(spark, [("2", "Supervisor"), ("8", "Non-Supervisor")], "supervis string, supertypt string")
    shares = staffing.supervisor_share(people, ["clean_name", "year"], levels=levels)
    assert rows(shares, "year", "supertypt", "per_supervis", "mean_los") == [(2023, "Supervisor", 75.0, 7.5), (2024, "Supervisor", 600 / 7, 7.5)]
    trends = staffing.employment_trends(people, ["clean_name", "year"])
    assert rows(trends.filter("year = 2023"), "clean_name", "total_emp", "total_tech", "total_stem", "total_analyst") == [
        ("NASA", 5.0, 0.0, 5.0, 0.0), ("USFS", 10.0, 4.0, 6.0, 2.0)]
    assert staffing.ratio_long(trends, ["clean_name", "year"]).count() == 4 * 7
    assert rows(staffing.largest_units(people, "occt", n=1)) == [("2210-IT, MANAGEMENT", 5.5)]
    roll = staffing.department_rollup(people, "agyt", "agysubt")
    assert rows(roll.filter("level = 'department'"), "name", "year", "Tech")[0] == ("AG-DEPARTMENT OF AGRICULTURE", 2023, 4.0)
    places = literal_table(spark, [("01", "ALABAMA")], "loc string, loct string")
    assert rows(staffing.add_location(cube, places).select("loct").distinct()) == [("ALABAMA",)]


# ---- hiring ----

POSTING = ("id string, agency string, subagency string, position string, series array<struct<Name: string, Code: string>>, "
           "grade_type array<struct<Code: string>>, date_posted string, date_closes string, hiring_path array<string>, major_duties array<string>, "
           "mco_tags array<string>, salary_rage array<struct<MinimumRange: string, MaximumRange: string, RateIntervalCode: string, Description: string>>, "
           "openings string, all_keywords string")


@pytest.fixture(scope="module")
def postings(spark):
    def posting(i, subagency, series, tags, pay, keywords, agency="DEPARTMENT OF AGRICULTURE", grades=("GS",), path=("public",)):
        return (i, agency, subagency, "IT SPECIALIST (DATA)", series, [(g,) for g in grades], "2024-10-01T00:00", "2024-10-15", list(path),
                ["Does a.", "Does b."], tags, [pay], "mANY", keywords)

    it, misc = ("Information Technology Management", "2210"), ("Miscellaneous", "0301")
    hourly, yearly = ("20", "30", "PH", "Per Hour"), ("60000", "70000", "PA", "Per Year")
    return spark.createDataFrame([
        posting("1", "FOREST SERVICE", [it, misc], ["02"], hourly, "Data, Technology"),
        posting("1", "FOREST SERVICE", [misc], ["01"], hourly, "Data, Technology"),
        posting("2", "U.S. FISH AND WILDLIFE SERVICE", [it], [], yearly, "Geospatial", grades=("GS", "GG")),
        posting("3", "FOREST SERVICE", [misc], None, yearly, "Permit"),
        posting("4", "FOREST SERVICE", [], ["02"], yearly, "Data"),
        posting("5", "HEADQUARTERS", [misc], [], ("x", "y", "PA", "Per Year"), "Product", agency="NATIONAL AERONAUTICS AND SPACE ADMINISTRATION"),
    ], POSTING)


def test_postings(postings, rows):
    tidy = hiring.postings_tidy(postings)
    assert rows(tidy, "id", "subagency", "all_series_code", "all_mco_tags", "mco_tags_tidy", "days_open", "total_keywords", "grade_type_code", "tidy_duties") == [
        ("1", "Forest Service", "0301, 2210", "01, 02", "01, 02, Cyber Secruity, Data Scientist", 14, 2, "GS", "1 Does a.. Does b."),
        ("1", "Forest Service", "0301, 2210", "01, 02", "01, 02, Cyber Secruity, Data Scientist", 14, 2, "GS", "1 Does a.. Does b."),
        ("2", "U.S. Fish And Wildlife Service", "2210", None, None, 14, 1, "GG", "2 Does a.. Does b."),
        ("2", "U.S. Fish And Wildlife Service", "2210", None, None, 14, 1, "GS", "2 Does a.. Does b."),
        ("5", "Headquarters", "0301", None, None, 14, 1, "GS", "5 Does a.. Does b.")]
    within = hiring.postings_tidy(postings, unique_ids=True)
    assert rows(within.filter("id = '1'"), "all_series_code") == [("0301",), ("0301, 2210",)]
    summary_rows = hiring.postings_summary(tidy, date_last_data="2025-01-01")
    assert rows(summary_rows.distinct(), "id", "clean_name", "category", "min_annual_salary", "it_specialist", "analysis_flag") == [
        ("1", "USFS", "Field", 41600.0, True, "enviro_agy"), ("2", "USFWS", "Field", 60000.0, True, "enviro_agy"),
        ("5", "NASA", "Research", None, False, "benchmark_agy")]
    top = hiring.top_series(summary_rows)
    assert rows(top, "clean_name", "value", "totals", "all_series", "IT_flag") == [
        ("NASA", "0301", 1, "Miscellaneous", "Not IT"), ("USFS", "0301", 2, "Miscellaneous", "Not IT"), ("USFS", "2210", 2, "IT Management", "IT"),
        ("USFWS", "2210", 2, "IT Management", "IT")]
    hits = hiring.keyword_hits(tidy)
    assert rows(hits, "subagency", "total_announcements", "data", "gis_pct")[0] == ("Forest Service", 2, 2, 0.0)
    assert rows(hiring.mission_critical_share(tidy), "subagency", "percent_mco")[0] == ("Forest Service", 100.0)


def test_a_series_code_has_one_name(spark, rows):
    data = [("A", "f", "0301", "Clerk"), ("A", "f", "0301", "Admin"), ("A", "f", "0301", "Admin"), ("A", "f", "0303", "B"), ("A", "f", "0303", "C"), ("A", "f", "0301, 0303", "x")]
    top = hiring.top_series(spark.createDataFrame(data, "clean_name string, analysis_flag string, all_series_code string, all_series string"), short_names={})
    assert rows(top, "value", "totals", "all_series") == [("0301", 4, "Admin"), ("0303", 3, "B")]


def test_announcement_history(spark, rows):
    schema = ("usajobs_control_number string, announcement_number string, position_open_date string, position_close_date string, position_expire_date string, "
              "job_categories array<struct<series: string>>, position_locations array<struct<positionLocationCity: string, positionLocationState: string, "
              "positionLocationCountry: string>>, hiring_paths array<struct<hiringPath: string>>, clean_name string, type string, category string")
    data = [
        ("1", "A-1", "2024-05-02", "2024-06-01", None, [("2210",), ("0301",)], [("Denver", "CO", "US"), ("Boise", "ID", "US")], [("public",)], "EPA", "enviro_agy", "Regulatory"),
        ("2", None, "2025-02-01", "2025-03-01", None, [("0401",)], None, [], "EPA", "enviro_agy", "Regulatory"),
        ("3", "A-3", "2025-07-01", "2025-08-01", None, None, [], None, "EPA", "enviro_agy", "Regulatory"),
        ("4", "A-4", "2019-02-01", "2019-03-01", None, [("1550",)], [], [], "EPA", "enviro_agy", "Regulatory")]
    history = hiring.history_tidy(spark.createDataFrame(data, schema))
    flat = hiring.children_consolidated(history)
    assert rows(flat, "usajobs_control_number", "unique_id", "it_flag", "job_series", "job_city", "job_country", "hiring_paths_all") == [
        ("1", "1--A-1", "IT", "0301, 2210", "Boise, Denver", "US", "public"), ("2", "2--NA", "not_IT", "0401", None, None, None),
        ("3", "3--A-3", "not_IT", None, None, None, None), ("4", "4--A-4", "IT", "1550", None, None, None)]
    yearly = hiring.it_share_by_period(history)
    assert rows(yearly, "period", "announcements", "num_it", "pct_it") == [(2024, 1, 1, 100.0), (2025, 1, 0, 0.0)]
    assert rows(hiring.it_share_by_period(history, by="quarter"), "period") == [("2024 Q2",), ("2025 Q1",)]
    assert rows(hiring.it_share_latest(yearly), "clean_name", "period") == [("EPA", 2025)]


def test_children_of_an_announcement_in_several_rows(spark, rows):
    schema = ("usajobs_control_number string, part int, job_categories array<struct<series: string>>, position_locations array<struct<positionLocationCity: string, "
              "positionLocationState: string, positionLocationCountry: string>>, hiring_paths array<struct<hiringPath: string>>")
    data = [("1", 1, [("2210",)], [("Denver", "CO", "US")], None), ("1", 2, [("0301",), ("2210",)], [], [("public",)]), ("1", 3, None, None, None),
            ("2", 1, [("0401",)], [("Boise", "ID", "US")], [("vet",)]), (None, 1, [("0801",)], None, None), (None, 2, [("0802",)], None, None)]
    flat = hiring.children_consolidated(spark.createDataFrame(data, schema))
    assert flat.columns == ["usajobs_control_number", "part", "job_series", "job_city", "job_state", "job_country", "hiring_paths_all"]
    assert rows(flat) == [(None, 1, "0801, 0802", None, None, None, None), (None, 2, "0801, 0802", None, None, None, None)] + [
        ("1", n, "0301, 2210", "Denver", "CO", "US", "public") for n in (1, 2, 3)] + [("2", 1, "0401", "Boise", "ID", "US", "vet")]


def test_openings_and_core_stats(spark, rows):
    schema = ("id bigint, subagency string, openings string, it_specialist boolean, user_research boolean, agile_startup_ux boolean, use_ai boolean, "
              "stem_job boolean, innovative_score double")
    data = [
        (1, "Forest Service", "Few", True, True, True, False, True, 8.0), (2, "Forest Service", "5", False, False, None, True, True, 9.0),
        (3, "Forest Service", None, False, False, False, False, False, 7.0), (4, "Forest Service", "Many", False, False, False, False, False, None),
        (5, "Bureau Of Reclamation", "1", True, False, False, False, False, 2.0), (6, None, "1", True, True, True, True, True, 9.0)]
    scored = spark.createDataFrame(data, schema)
    assert rows(hiring.openings_estimate(scored)) == [("Bureau Of Reclamation", 1, 1, 0), ("Forest Service", 3, 10, 7)]
    assert rows(hiring.openings_estimate(scored, null_weight=1))[1] == ("Forest Service", 4, 11, 7)
    staff = spark.createDataFrame([("Forest Service", 2024, 100), ("Forest Service", 2023, 1), ("Bureau Of Reclamation", 2024, 10)], "name string, year int, total_workforce bigint")
    stats = hiring.hiring_core_stats(scored, staff)
    assert rows(stats, "subagency", "num_listings", "num_tech", "tech_wf_ratio", "num_inno_processes", "num_ai", "num_stem", "inno_max", "inno_tendency", "inno_undercount", "expected_tech") == [
        ("Bureau Of Reclamation", 1, 1, 0.1, 0, 0, 0, 2, 0, 0, pytest.approx(2 / 3)), ("Forest Service", 3, 1, 0.01, 2, 1, 2, 9, 3, 5, pytest.approx(2.0))]


def test_scored_texts(spark, rows):
    jobs = spark.createDataFrame([(1, "s", "code"), (2, "s", "code"), (3, "t", "dig")], "id int, subagency string, tidy_duties_noid string")

    def score(texts: pd.Series) -> pd.DataFrame:
        reply = {"code": '{"use_ai":"yes","innovative_score":7,"programming_types":"[Python, R]"}', "dig": '{"innovative_score":"2","use_ai":false,"programming_types":"None"}'}
        return pd.DataFrame({"gpt_desc": texts.map(reply)})

    parsed = hiring.parse_scored_text(hiring.score_duties(jobs, score))
    assert rows(parsed, "id", "use_ai", "innovative_score") == [(1, True, 7.0), (2, True, 7.0), (3, False, 2.0)]
    assert rows(hiring.flag_means(parsed, flags=["use_ai"])) == [("s", 1.0), ("t", 0.0)]
    assert rows(hiring.score_distribution(parsed), "subagency", "innovative_score", "pct_jobs") == [("s", 7.0, 100.0), ("t", 2.0, 100.0)]
    assert rows(hiring.required_languages(parsed)) == [("s", "Python, R", 2)]
    assert rows(hiring.high_scores(parsed), "id") == [(1,), (2,)]


# ---- open source ----

def test_repositories(spark, rows, tmp_path):
    header = "repo_url,description,languages,num_commits,first_commit_date,last_commit_date,num_contributors,contributor_usernames,agency,organization"
    (tmp_path / "noaa").mkdir()
    (tmp_path / "other").mkdir()
    noaa, usace = "National Oceanic and Atmospheric Administration", "U.S. Army Corps Of Engineers"
    (tmp_path / "noaa" / "A_data.csv").write_text("\n".join([
        header, f'u1,NA,"R, HTML",10,2019-01-01T00:00:00Z,2025-01-02T03:04:05Z,2,"x, y",{noaa},A', f'u2,"a ""b""",R,5,2022-01-01T00:00:00Z,2022-02-01T00:00:00Z,1,x,{noaa},A',
        f"u3,NA,NA,NA,NA,NA,NA,NA,{noaa},A", f"u4,NA,R,1,2010-01-01T00:00:00Z,2021-10-01T23:59:59Z,1,x,{noaa},A"]))
    (tmp_path / "other" / "B_data.csv").write_text("\n".join([header, f'u5,NA,"C++, Go, R, Python, Java, Perl, Zig",7,2023-01-01T00:00:00Z,2025-02-01T00:00:00Z,NA,NA,{usace},B']))
    repos = opensource.with_commit_days(opensource.read_repos(spark, str(tmp_path / "noaa"), str(tmp_path / "other")))
    kept = opensource.repos_in_window(repos)
    assert rows(kept, "repo_url", "agency") == [("u1", noaa), ("u2", noaa), ("u5", "U.S. Army Corps of Engineers")]
    activity = opensource.repo_activity(kept)
    assert rows(activity) == [(noaa, 1, 15, 3, 2, 0.5), ("U.S. Army Corps of Engineers", 1, 7, 0, 1, 1.0)]
    spend = spark.createDataFrame([(noaa, 4.0, 0), ("National Park Service", 1.0, 0), ("U.S. Army Corps of Engineers", None, 0)], "sub_agency string, total_funding double, benchmark int")
    ratio = opensource.repos_per_million(activity, spend)
    assert rows(ratio, "sub_agency", "repo_per_million") == [(noaa, 0.5)]
    names = literal_table(spark, [(noaa, "NOAA"), ("U.S. Army Corps of Engineers", "USACE"), ("Forest Service", "USFS")], "sub_agency string, sub_agency_abbrev string")
    table = opensource.repo_table(ratio, names)
    assert rows(table, "sub_agency_abbrev", "per_repos_commits_6m") == [("NOAA", "50%")]
    top = opensource.language_top(opensource.language_counts(kept), names)
    assert rows(top, "sub_agency_abbrev", "languages", "count") == [
        ("NOAA", "R", 2), ("USACE", "C++", 1), ("USACE", "Go", 1), ("USACE", "Java", 1), ("USACE", "Other", 2), ("USACE", "Perl", 1), ("USACE", "Python", 1)]
    assert {r.languages: r.sort_rank for r in top.collect()}["Other"] == 7 - 0
    assert rows(opensource.language_matrix(kept, ["R", "HTML"])) == [(noaa, 2, 1), ("U.S. Army Corps of Engineers", 1, 0)]


def test_repo_facts(spark, rows):
    repos = spark.createDataFrame([("a", "u/a", None, 5), ("b", "u/b", "empty", 0), ("c", "u/c", None, 1)], "repo string, repo_url string, description string, size int")
    languages = spark.createDataFrame([("a", "R"), ("a", "C")], "repo string, language string")
    commits = spark.createDataFrame([("a", "2020-01-02"), ("a", "2019-01-01"), ("b", "2019-01-01")], "repo string, author_date string")
    people = spark.createDataFrame([("a", "y"), ("a", "x")], "repo string, login string")
    out = opensource.repo_facts(repos, languages, commits, people)
    assert rows(out, "repo", "languages", "num_commits", "first_commit_date", "last_commit_date", "num_contributors", "contributor_usernames") == [
        ("a", "C, R", 2, "2019-01-01", "2020-01-02", 2, "x, y"), ("b", None, None, None, None, None, None), ("c", None, 0, None, None, None, None)]


def test_repo_records_are_dealt_by_their_size(spark, rows, tmp_path, monkeypatch):
    from civicgauge.operators import aggregate
    from queries import stand_ins
    from queries.registry import SCHEMAS

    def save(table, data):
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        kinds = spark.createDataFrame([], SCHEMAS[table]).schema
        spark.createDataFrame([tuple(x.get(n) for n in names) for x in data], kinds).write.parquet(f"{tmp_path}/{table}.parquet")

    save("nation", [{"n_nationkey": 1, "n_name": "N"}])
    save("customer", [{"c_custkey": k, "c_name": f"c{k}", "c_nationkey": 1, "c_acctbal": 1.0} for k in (1, 2, None)])
    save("orders", [{"o_orderkey": k, "o_custkey": k % 2 + 1} for k in range(6)] + [{"o_orderkey": 9}])
    save("part", [{"p_partkey": k, "p_brand": f"b{k % 3}"} for k in range(5)])
    save("lineitem", [{"l_orderkey": k % 7, "l_partkey": k % 5, "l_suppkey": k % 4 if k % 6 else None} for k in range(35)])
    columns = ["repo", "num_commits", "languages", "num_contributors", "contributor_usernames"]
    small = opensource.repo_facts(**stand_ins.repo_records(spark, str(tmp_path)))
    monkeypatch.setattr(aggregate, "SMALL_TABLE", 10)
    monkeypatch.setattr(aggregate, "ROWS_IN_TASK", 3)
    large = opensource.repo_facts(**stand_ins.repo_records(spark, str(tmp_path)))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(repo#\d+L, login#\d+, 12\)", plan) and re.search(r"hashpartitioning\(repo#\d+L, language#\d+, 12\)", plan)
    assert re.search(r"hashpartitioning\(repo#\d+L, 12\)", plan)
    assert large.rdd.getNumPartitions() == 12
    assert rows(large, *columns) == rows(small, *columns) and len(rows(small)) == 3


# ---- summary ----

def test_summary(spark, rows):
    def table(data, schema):
        return spark.createDataFrame(data, schema)

    out = summary.indicator_summary(
        table([("EPA", "Yes"), ("NASA", "No")], "clean_name string, flag string"), table([("EPA", 12.0)], "clean_name string, tech_pct double"),
        table([("NASA", 3)], "clean_name string, tech_chal bigint"), table([("EPA", 50.0)], "clean_name string, pct_it double"),
        table([("EPA", 0.5, None)], "clean_name string, per_repos_commits_6m double, repo_per_million double"))
    assert rows(out) == [("EPA", "Yes", 0.12, None, 0.5, 0.5, None, 1), ("NASA", "No", None, 3, None, None, None, 0)]
    assert "'24 Workforce Tech %" in summary.with_titles(out, {"workforce_tech": "'24 Workforce Tech %"}).columns
