from datetime import date

import pytest
from pyspark.sql import functions as F

from civicgauge import functions as fn


def values(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(column).collect()]


def texts(spark, data, column):
    return values(spark, "t string", [(x,) for x in data], column)


@pytest.mark.parametrize("raw, title", [
    ("AG11-FOREST SERVICE", "Ag11-Forest Service"), ("U.S. FISH AND WILDLIFE", "U.s. Fish And Wildlife"), ("o'neil (abc) x/y", "O'neil (Abc) X/Y"),
    ("'hello' ..a a..b", "'Hello' ..A A..b"), ("éa\nöb", "Éa\nÖb"), ("ßa", "Ssa"), ("", ""), (None, None),
])
def test_title_case(spark, raw, title):
    assert texts(spark, [raw], fn.title_case("t")) == [title]


def test_abbreviation_dots_are_not_wildcards(spark):
    assert texts(spark, ["U.s. Fish", "Uxsy Fish"], fn.expand_abbreviations("t", {"U.s.": "U.S."})) == ["U.S. Fish", "Uxsy Fish"]


def test_pieces(spark):
    data = ["Dept - Sub - More", "Dept – Sub", "Dept", None]
    dash = r"\s*(?:–|-)\s*"
    assert texts(spark, data, fn.nth_piece("t", dash, 2)) == ["Sub", "Sub", None, None]
    assert texts(spark, data, fn.nth_piece("t", dash, 2, missing="")) == ["Sub", "Sub", "", ""]
    assert texts(spark, ["2024-05-01T00:00", "2024-05-01"], fn.before_first("t", "T")) == ["2024-05-01", "2024-05-01"]
    assert texts(spark, ["a:b:c", "none"], fn.after_first("t", ":")) == ["b:c", None]


def test_keys_keep_nulls_apart(spark):
    data = [("a", None, "b"), ("a", "b", None)]
    assert values(spark, "x string, y string, z string", data, fn.make_key("x", "y", "z")) == ["a-NA-b", "a-b-NA"]


def test_pad_keeps_long_codes(spark):
    assert texts(spark, ["7", "0301", "12345", None], fn.pad_code("t", 4)) == ["0007", "0301", "12345", None]


def test_matching(spark):
    data = ["Big Data", "biography", None]
    assert texts(spark, data, fn.match_any("t", ["data", "x.y"], ignore_case=True)) == [True, False, False]
    assert texts(spark, ["x.y", "xzy"], fn.match_any("t", ["x.y"])) == [True, False]
    assert texts(spark, ["data dates data", "none", None], fn.count_term("t", "da")) == [3, 0, None]
    assert texts(spark, ["a", "", None], fn.has_text("t")) == [True, False, False]


@pytest.mark.parametrize("raw, amount", [
    ("$1,000.99", 1000.0), ("5000", 5000.0), ("No monetary prize for this challenge", 0.0), ("unknown", 0.0), ("junk", None),
    ("$", None), ("-3.5", -3.0), (None, None),
])
def test_parse_money(spark, raw, amount):
    assert texts(spark, [raw], fn.parse_money("t")) == [amount]


def test_dates(spark):
    data = ["2024-05-31T23:59:59", "2024-02-30", "x", None]
    assert texts(spark, data, fn.parse_date("t")) == [date(2024, 5, 31), None, None, None]
    assert texts(spark, ["2024-05-31"], fn.quarter_label(fn.parse_date("t"))) == ["2024 Q2"]
    assert texts(spark, ["2024-05-31"], fn.year_of(fn.parse_date("t"))) == [2024]
    days = fn.duration_days(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    assert texts(spark, ["x"], days) == [30]


def test_window_bounds_are_strict(spark):
    rows = [("2021-09-30", "2021-10-01"), ("2021-09-30", "2021-10-02"), ("2025-03-24", "2025-03-25"), ("2025-03-23", "2025-03-25"), (None, "2025-01-01")]
    test = fn.active_in_window(F.col("a").cast("date"), F.col("b").cast("date"), "2021-10-01", "2025-03-24")
    assert values(spark, "a string, b string", rows, test) == [False, True, False, True, None]
    stamps = fn.active_in_window(F.col("a").cast("timestamp"), F.concat("b", F.lit(" 10:00:00")).cast("timestamp"), "2021-10-01", "2025-03-24")
    assert values(spark, "a string, b string", rows, stamps) == [False, True, False, True, None]


def test_numbers(spark):
    assert values(spark, "a bigint, b bigint", [(1, 2), (1, 0), (None, 2)], fn.ratio("a", "b")) == [0.5, None, None]
    assert values(spark, "a int, b double", [(1, 2.5), (None, 2.0), (None, None)], fn.row_sum(["a", "b"])) == [3.5, 2.0, 0.0]
    assert values(spark, "v double", [(14999.9,), (15000.0,), (None,)], fn.bin_to("v", 10000)) == [10000, 20000, None]
    assert values(spark, "v string, u string", [("10", "Per Hour"), ("10", "Per Year"), ("x", "Per Hour")], fn.annualise("v", "u")) == [20800.0, 10.0, None]
    assert values(spark, "v double", [(0.4454,), (None,)], fn.percent_text("v")) == ["45%", None]
    weights = {"Few": 2, "Many": 3}
    assert texts(spark, ["FEW", "mANY", "7", "lots", None], fn.word_weight("t", weights)) == [2, 3, 7, None, None]
    assert texts(spark, [None], fn.word_weight("t", weights, null_weight=1)) == [1]


def test_exact_sum_does_not_depend_on_order(spark):
    data = [(0.1,)] * 1000 + [(1e12,)]
    df = spark.createDataFrame(data, "v double")
    sums = {df.repartition(n).agg(fn.exact_sum("v")).first()[0] for n in (1, 3, 7)}
    assert sums == {1e12 + 100.0}


def test_recode_rules_and_tiers(spark):
    groups = {"One": ["a", "b"], "Two": ["b", "c"]}
    data = ["a", "b", "c", "d", None]
    assert texts(spark, data, fn.recode("t", groups)) == ["One", "One", "Two", "d", None]
    assert texts(spark, data, fn.recode("t", groups, "rest")) == ["One", "One", "Two", "rest", "rest"]
    assert texts(spark, data, fn.group_of("t", groups)) == ["One", "One", "Two", None, None]
    rules = [("d", "Dept", "D"), ("s", "Sub", "S")]
    pairs = [("Dept", "Sub"), (None, "Sub"), ("x", None)]
    assert values(spark, "d string, s string", pairs, fn.first_rule(rules)) == ["D", "S", None]
    tiers = fn.classify_tiers("t", ["XXXX", "****"], {"tech": ["1550"]}, "out", "in")
    assert texts(spark, ["1550", "XXXX", "****", "0401", None], tiers) == ["tech", "out", "out", "in", "in"]
    band = fn.crosswalk_band("t", {"GS-12": ["ZP-03"]}, {"low": ["GS-09"], "high": ["GS-12"]})
    assert texts(spark, ["ZP-03", "GS-09", "GS-12", "AD-00", None], band) == ["high", "low", "high", None, None]


def test_label_codes_match_whole_codes(spark):
    labels = {"01": "Cyber", "02": "Data"}
    assert texts(spark, ["01, 02", "101", "02", "", None], fn.label_codes("t", labels)) == ["01, 02, Cyber, Data", "101", "02, Data", "", None]
    assert texts(spark, ["02, 01"], fn.label_codes("t", labels, first_only=True)) == ["02, 01, Data"]


def test_records(spark):
    data = ['"yes"', "true", " No}", '"false"', "perhaps", None]
    assert texts(spark, data, fn.normalise_bool("t")) == [True, True, False, False, None, None]
    objects = ['{"a": "1", "b": "x"}', '{"b": "y", "a": "2"}', "broken", None]
    parsed = texts(spark, objects, fn.parse_object("t", "a string, b string"))
    assert [None if p is None else (p.a, p.b) for p in parsed] == [("1", "x"), ("2", "y"), (None, None), None]


def test_lists(spark):
    assert texts(spark, ["R, HTML", "", None], fn.list_items("t")) == [["R", "HTML"], [], None]
    joined = fn.join_items(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")), distinct=True, ordered=True)
    assert texts(spark, ["x"], joined) == ["a, b"]
