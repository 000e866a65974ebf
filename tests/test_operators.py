import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicgauge import functions as fn
from civicgauge.operators import aggregate, combine, incremental, joins, project, quality, ranking, reshape, stats


# ---- columns and rows ----

def test_snake_names():
    assert project.snake_names(["Challenge ID", "% IT", "positionLocationCity", "a.b", "A b", "2nd"]) == [
        "challenge_id", "percent_it", "position_location_city", "a_b", "a_b_2", "x2nd"]


def test_relocate_and_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert project.relocate(df, ["d"], after="a").columns == ["a", "d", "b", "c"]
    assert project.relocate(df, ["d", "c"]).columns == ["d", "c", "a", "b"]
    assert project.column_range(df, "b", "d") == ["b", "c", "d"]
    with pytest.raises(ValueError):
        project.rename_to_title(df, "z", "t")


def test_members_and_nulls(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(project.keep_members(df, "k", ["a"])) == [("a",)]
    assert rows(project.drop_members(df, "k", ["a"])) == [(None,), ("b",)]
    long_list = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert rows(project.keep_members(df, "k", long_list)) == [(None,), ("a",)]
    assert rows(project.drop_members(df, "k", long_list)) == [("b",)]


def test_between_bounds(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "y int")
    assert rows(project.between(df, "y", 2, 3)) == [(2,), (3,)]
    assert rows(project.between(df, "y", 2, 3, open_end=True)) == [(2,)]


# ---- joins ----

def test_star_keeps_fact_rows_and_stops_on_repeated_keys(spark, rows):
    fact = spark.createDataFrame([("1", 10), ("9", 20), (None, 30)], "occ string, n int")
    dim = spark.createDataFrame([("1", "one"), ("2", "two")], "occ string, name string")
    assert rows(joins.enrich_star(fact, [(dim, ["occ"])], check_unique=True)) == [(None, 30, None), ("1", 10, "one"), ("9", 20, None)]
    with pytest.raises(Exception, match="more than one row"):
        joins.enrich_star(fact, [(dim.union(dim), ["occ"])], check_unique=True).collect()


def test_semi_and_anti_treat_null_as_a_value(spark, rows):
    a = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (None,), (2,)], "k int")
    assert rows(joins.keep_matching(a, b, ["k"])) == [(None,), (2,), (2,)]
    assert rows(joins.drop_matching(a, b, ["k"])) == [(1,)]


def test_natural_join_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        joins.join_natural(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int"))


def test_right_join_keeps_reference_list(spark, rows):
    data = spark.createDataFrame([("x", 1)], "name string, n int")
    listed = spark.createDataFrame([("x",), ("y",)], "entity string")
    assert rows(joins.join_on(data, listed, {"name": "entity"}, "right")) == [("x", 1), ("y", None)]


@pytest.mark.parametrize("reduced", [False, True])
def test_group_total(spark, rows, reduced):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "g string, n int")
    out = joins.with_group_total(df, ["g"], {"total": F.sum("n")}, reduced)
    assert rows(out) == [(None, 4, 4), ("a", 1, 3), ("a", 2, 3)]


def test_align_lookup_scalar_replace(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", 5), ("z", 6)], "k string, b int")
    assert rows(joins.align_columns([a, b], ["k"])) == [("x", 1, None), ("y", 2, 5), ("z", None, 6)]
    assert rows(joins.lookup(a, b, "k", "k", "b", default=0)) == [("x", 1, 0), ("y", 2, 5)]
    assert rows(joins.with_scalar(a, "m", b.agg(F.avg("b").alias("m")))) == [("x", 1, 5.5), ("y", 2, 5.5)]
    fixed = spark.createDataFrame([(9, "y")], "a int, k string")
    assert rows(joins.replace_rows(a, fixed, ["k"])) == [("x", 1), ("y", 9)]


# ---- aggregates ----

def test_sums_and_counts(spark, rows):
    df = spark.createDataFrame([("a", 1, True), ("a", None, None), ("b", None, False), (None, 3, True)], "g string, v int, f boolean")
    assert rows(aggregate.sum_by(df, ["g"], {"s": "v"})) == [(None, 3), ("a", 1), ("b", 0)]
    assert rows(df.groupBy("g").agg(aggregate.count_when(F.col("f")))) == [(None, 1), ("a", 1), ("b", 0)]
    assert rows(aggregate.count_non_null_by(df, ["g"])) == [(None, 1, 1), ("a", 1, 1), ("b", 0, 1)]
    assert rows(aggregate.count_distinct_by(df, ["g"], "v")) == [(None, 1), ("a", 1), ("b", 0)]
    assert rows(aggregate.range_by(df, ["g"], "v"))[1] == ("a", 1, 1)
    assert rows(aggregate.count_and_sums(df, ["g"], ["v"])) == [(None, 1, 3), ("a", 2, 1), ("b", 1, 0)]


def test_concatenations(spark, rows):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", None), (1, "b", "x"), (2, None, None), (None, "c", "y")], "k int, v string, w string")
    assert rows(aggregate.concat_distinct_by(df, ["k"], {"vs": "v", "ws": "w"})) == [(None, "c", "y"), (1, "a, b", "x"), (2, None, None)]
    assert rows(aggregate.concat_all_by(df, ["k"], "v", "vs")) == [(None, "c"), (1, "a, b, b"), (2, None)]


def test_crosstab_with_totals(spark, rows):
    df = spark.createDataFrame([("2020", "e", "p", 1), ("2020", "e", "q", 2), ("2021", None, "p", 4)], "y string, f string, t string, n int")
    out = aggregate.crosstab_with_totals(df, ["y", "f"], "t", ["p", "q"], "n")
    assert rows(out) == [("2020", "e", 1, 2, 3), ("2021", None, 4, 0, 4), ("All", None, 5, 2, 7)]
    shares = aggregate.with_shares(out, ["p", "q", "All"], "All", 1.0)
    assert all(abs(r.p + r.q - r.All) < 1e-12 for r in shares.collect())


def test_per_member_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice("xyz"), rng.randint(1, 3), rng.choice(["m1", "m2", "m3", None]), rng.randint(0, 5)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, t string, y int, m string, n int")
    got = {(r.g, r.t, r.y): (r.total, r.members, r.per_member) for r in aggregate.per_member(df, ["g", "t", "y"], ["g", "y"], "m", "n").collect()}
    totals, members = Counter(), defaultdict(set)
    for g, t, y, m, n in data:
        totals[g, t, y] += n
        members[g, y] |= {m} - {None}
    assert got == {k: (v, len(members[k[0], k[2]]), v / len(members[k[0], k[2]])) for k, v in totals.items()}


def test_period_change(spark, rows):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 15), ("b", 2, 5), ("c", 3, 7)], "k string, y int, n int")
    assert rows(aggregate.period_change(df, ["k"], "y", "n", 1, 2)) == [("a", 10, 15, 5, 50.0), ("b", 0, 5, 5, None)]


# ---- ranks ----

@pytest.mark.parametrize("parts", [1, 3, 64])
def test_top_n_with_other_against_brute_force(spark, parts):
    rng = random.Random(parts)
    data = [(g, f"i{i}", rng.randint(0, 6)) for g in ("hot", "small", None) for i in range(200 if g == "hot" else 4)]
    df = spark.createDataFrame(data, "g string, item string, n bigint").repartition(5)
    got = {(r.g, r.item): r.n for r in ranking.top_n_with_other(df, ["g"], "item", "n", 5, parts=parts).collect()}
    want = Counter()
    for g in ("hot", "small", None):
        ordered = sorted(((-n, i) for h, i, n in data if h == g and n > 0))
        for place, (n, i) in enumerate(ordered):
            want[g, i if place < 5 else "Other"] -= n
    assert got == dict(want)
    assert sum(got.values()) == sum(n for *_, n in data)


def test_top_n_and_latest(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 1)], "g string, i int, n int")
    assert rows(ranking.top_n_per_group(df, ["g"], "n", ["i"], 1)) == [("a", 1, 5), ("b", 1, 1)]
    for reduced in (False, True):
        assert rows(ranking.latest_per_group(df, ["g"], "n", reduced)) == [("a", 1, 5), ("a", 2, 5), ("b", 1, 1)]
        assert sorted(r.percent for r in ranking.share_in_group(df, ["g"], "n", reduced=reduced).collect()) == [4 / 14, 5 / 14, 5 / 14, 1.0]
    assert rows(ranking.top_n_global(df, "n", ["g", "i"], 2, F.col("g") == "b")) == [("a", 1, 5), ("a", 2, 5), ("b", 1, 1)]


def test_display_order_puts_other_last(spark, rows):
    df = spark.createDataFrame([("R", 1), ("Python", 5), ("Other", 9), ("R", 4)], "l string, n int")
    assert rows(ranking.order_rank(df, "l", "n", last="Other")) == [("Other", 3), ("Python", 1), ("R", 2)]
    assert rows(ranking.with_order_rank(df, "l", "n", last="Other"), "l", "sort_rank") == [("Other", 3), ("Python", 1), ("R", 2), ("R", 2)]


def test_mark_duplicates(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 3), (None, 4), (None, 5)], "k string, i int")
    assert rows(ranking.mark_duplicates(df, ["k"], ["i"])) == [
        (None, 4, False), (None, 5, True), ("a", 1, False), ("a", 2, True), ("a", 3, True)]


# ---- shapes ----

def test_pivot_unpivot_densify(spark, rows):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 4), ("b", "other", 8)], "k string, t string, n bigint")
    wide = reshape.pivot_wide(df, ["k"], "t", ["x", "y"], "n")
    assert rows(wide) == [("a", 3, 0), ("b", 0, 4)]
    long = [("a", "x", 3), ("a", "y", 0), ("b", "x", 0), ("b", "y", 4)]
    assert rows(reshape.unpivot_long(wide, ["k"], ["x", "y"])) == long
    assert rows(reshape.densify(df, ["k"], "t", ["x", "y"], "n")) == long
    listed = spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(reshape.complete_entities(wide, listed, ["k"], {"x": 0, "y": 0})) == [("a", 3, 0), ("c", 0, 0)]


def test_items(spark, rows):
    df = spark.createDataFrame([("A", "r1", "R, HTML, R"), ("A", "r2", "R"), ("B", "r3", None), ("B", "r4", "")], "e string, r string, l string")
    assert rows(reshape.item_counts(df, ["e"], "r", "l")) == [("A", "HTML", 1), ("A", "R", 2)]
    assert rows(reshape.item_matrix(df, ["e"], "r", "l", ["R", "HTML", "Go"])) == [("A", 2, 1, 0), ("B", 0, 0, 0)]
    assert reshape.explode_delimited(df, "l").count() == 4
    assert reshape.explode_delimited(df, "l", keep_empty=True).count() == 6


def test_children(spark, rows):
    schema = "id int, c array<struct<f: string>>, a array<string>"
    data = [(1, [("b",), ("a",), ("b",)], ["p"]), (1, [("c",)], []), (2, [], None), (3, None, ["q", None])]
    df = spark.createDataFrame(data, schema)
    lists = {"fs": ("c", "f"), "as": ("a", None)}
    assert rows(reshape.consolidate_children(df, lists)) == [(1, "a, b", "p"), (1, "c", None), (2, None, None), (3, None, "q")]
    assert rows(reshape.consolidate_children_by(df, ["id"], lists)) == [(1, "a, b, c", "p"), (2, None, None), (3, None, "q")]
    across = [(1, "a, b, c", "p"), (1, "a, b, c", "p"), (2, None, None), (3, None, "q")]
    assert rows(reshape.consolidate_children_across(df, ["id"], lists), "id", "fs", "as") == across
    assert rows(reshape.unnest(df, "c"), "id", "f") == [(1, "a"), (1, "b"), (1, "b"), (1, "c")]
    assert reshape.unnest(df, "c", keep_empty=True).count() == 6


def test_children_by_nested_keys_equal_two_rounds(spark, rows):
    schema = "id int, name string, day int, c array<struct<f: string>>, a array<string>, wide string"
    rng = random.Random(8)
    data = [(rng.choice([1, 2, None]) if i % 2 else 10 + i, rng.choice(["x", None]) if i % 2 else "y", rng.choice([1, 2, None]),
             rng.choice([None, [], [("p",), ("q",)], [("r",), (None,)]]), rng.choice([None, [], ["u"], ["v", "u"]]), f"w{i}") for i in range(40)]
    df = spark.createDataFrame(data, schema)
    lists, more = {"fs": ("c", "f")}, {"as": ("a", None)}
    once = reshape.consolidate_children_across(df, ["id", "name"], lists, more_keys=["day"], more_lists=more)
    twice = reshape.consolidate_children_across(reshape.consolidate_children_across(df, ["id", "name"], lists), ["id", "name", "day"], more)
    assert sorted(once.columns) == sorted(twice.columns)
    names = ["wide", "id", "name", "day", "fs", "as"]
    assert rows(once, *names) == rows(twice, *names) and once.count() == 40


def test_texts_of_a_large_group_come_in_parts(spark, rows):
    df = spark.range(2500).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.lit(None)).alias("k"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0").alias("v"))
    found = rows(aggregate.texts_in_parts(df.union(spark.createDataFrame([("none", None)], "k string, v string")), ["k"], "v", "t", most=300))
    assert [(k, part, t.count(",") + 1) for k, part, t in found] == [(None, 1, 200), ("hot", 1, 300), ("hot", 2, 300), ("hot", 3, 200)]
    assert found[1][2].startswith("0001, 0002, 0003, 0004, 0006") and found[2][2].split(", ")[0] > found[1][2].split(", ")[-1]


def test_checks_run_with_the_job(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (5, "b", 1.0), (9, None, 2.0), (None, "a", 3.0)], "n int, k string, v double")
    checks = quality.Checks(
        ranges={"outside": ("n", 2, 8)}, filled=["v", "k"], periods=["n"], vocabulary={"k": ["a"]}, flags={"large": F.col("v") > 1}, distinct={"keys": ["k"]})
    written, figures = quality.written_with_checks(df.filter("n IS NULL OR n > 0"), checks)
    assert figures == {"n_rows": 4, "outside": 2, "null_v": 1, "null_k": 1, "min_n": 1, "max_n": 9, "k_a": 2, "k_other": 2, "large": 2, "keys": 3}
    assert written.count() == 4 and quality.range_violations(df, "n", 2, 8).count() == figures["outside"]
    observed, _ = quality.observed(spark.read.schema("n int, k string, v double").parquet(written.inputFiles()[0].rsplit("/", 1)[0]), checks)
    text = observed._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text
    assert rows(quality.report_of(df, {"a": 1, "b": None})) == [("a", "1"), ("b", None)]


def test_flatten_and_twins(spark, rows):
    df = spark.createDataFrame([(1, (2, (3,)), [4])], "a int, s struct<b: int, t: struct<c: int>>, l array<int>")
    flat = reshape.flatten_struct(df)
    assert flat.columns == ["a", "s_b", "s_t_c", "l"] and rows(flat, "s_b", "s_t_c") == [(2, 3)]
    wide = spark.createDataFrame([("x", 1, 0.5, 9)], "id string, r_count int, r_per double, py_count int")
    assert reshape.twin_columns(wide.columns) == {"r_count": "r_per"}
    assert rows(reshape.unpivot_twins(wide, ["id"])) == [("x", "r", 1, 0.5)]


def test_split_to_columns(spark, rows):
    df = spark.createDataFrame([("a - b – c",), ("a",), (None,)], "t string")
    out = reshape.split_to_columns(df, "t", r"\s*(?:–|-)\s*", ["x", "y"])
    assert rows(out, "x", "y") == [(None, None), ("a", None), ("a", "b")]


# ---- stacks ----

def test_stacks(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(combine.union_strict(a, b)) == [(1, "x"), (2, "y")]
    assert rows(combine.union_by_name(a, b.select("i"))) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        combine.union_strict(a, b.select("i"))
    pulls = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p1")], "id int, page string")
    assert rows(combine.distinct_rows(pulls, ignore=["page"])) == [(1,), (2,)]


# ---- statistics and quality ----

def test_trend(spark):
    points = [("up", 2000 + i, 3.0 * i + 1) for i in range(5)] + [("one", 2000, 1.0)] + [("flat", 2000, 1.0), ("flat", 2000, 2.0)]
    out = {r.g: r for r in stats.trend_by_group(spark.createDataFrame(points, "g string, x int, y double"), ["g"], "x", "y").collect()}
    assert out["up"].slope == pytest.approx(3.0) and out["up"].r2 == pytest.approx(1.0) and out["up"].slope_se == pytest.approx(0.0, abs=1e-6)
    assert (out["one"].slope, out["one"].r2, out["one"].n_points) == (None, None, 1)
    assert (out["flat"].slope, out["flat"].slope_se) == (None, None)


def test_scenarios(spark, rows):
    df = spark.createDataFrame([("big", 9), ("small", 1), (None, 2)], "m string, n int")
    out = stats.with_scenarios(df, "m", ["big"]).groupBy("scenario").agg(F.sum("n"))
    assert rows(out) == [("all", 12), ("without", 3)]


def test_reports(spark, rows):
    df = spark.createDataFrame([("e", 1, "p"), ("e", 1, "p"), ("e", 2, "q"), ("f", 3, "p"), ("f", 3, "q")], "g string, k int, v string")
    assert rows(quality.duplicate_report(df, ["g"])) == [("e", 3, 2, 1), ("f", 2, 2, 0)]
    assert rows(quality.key_consistency(df, ["k"], "v")) == [(3, 2)]
    assert rows(quality.range_violations(df, "k", low=2, high=2).select("k").distinct()) == [(1,), (3,)]
    assert rows(quality.coverage_report(df, ["g"], "k", {"p": F.col("v") == "p"})) == [("e", 1, 2, 3, 2), ("f", 3, 3, 2, 1)]
    assert rows(quality.vocabulary_report(df, "v")) == [("p", 3), ("q", 2)]


# ---- daily pulls ----

def test_first_seen(spark, rows):
    schema = "id string, v int"
    store = spark.createDataFrame([("a", 1), (None, 2)], schema)
    pull = spark.createDataFrame([("a", 9), ("b", 3), ("b", 4), (None, 5)], schema)
    once = incremental.append_first_seen(store, pull, "id")
    assert rows(once) == [(None, 2), ("a", 1), ("b", 3), ("b", 4)]
    assert rows(incremental.append_first_seen(once, pull, "id")) == rows(once)
    assert rows(incremental.closed_since(store, pull.filter("id = 'b'"), "id")) == [(None, 2), ("a", 1)]


def test_consolidate_hits(spark, rows):
    data = [("1", "Tech", 1, "old"), ("1", "Data", 2, "old"), ("1", "Data", 3, "new"), ("2", "Data", 1, "x")]
    pulls = spark.createDataFrame(data, "id string, keyword string, page int, title string")
    assert rows(incremental.consolidate_hits(pulls, ["id"], "keyword", volatile=["page"]), "id", "title", "all_keywords") == [
        ("1", "new", "Data, Data, Tech"), ("1", "old", "Data, Data, Tech"), ("2", "x", "Data")]
    distinct = incremental.consolidate_hits(pulls, ["id"], "keyword", volatile=["page"], distinct=True)
    assert rows(distinct, "id", "all_keywords")[0] == ("1", "Data, Tech")


def test_scorer_sees_each_text_once(spark, rows, tmp_path):
    log = tmp_path / "calls"

    def score(texts: pd.Series) -> pd.DataFrame:
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return pd.DataFrame({"n": texts.str.len()})

    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, t string")
    out = incremental.enrich_unique(df, "t", score, "n int")
    assert rows(out) == [(1, "aa", 2), (2, "aa", 2), (3, "b", 1), (4, None, None)]
    assert rows(out, "n") and sorted(log.read_text().split()) == ["aa", "b"]


def test_names_stay_unique():
    assert project.snake_names(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_null_keys_meet_when_aligned(spark, rows):
    a, b = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int"), spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert rows(joins.align_columns([a, b], ["k"]), "k", "a", "b") == [(None, 1, 3), ("x", 2, None), ("y", None, 4)]


def test_null_keys_of_a_dimension_may_repeat(spark):
    assert joins.unique_by(spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, v int"), ["k"]).count() == 3


def test_separators_are_plain_text(spark, rows):
    df = spark.createDataFrame([("e", 1, "HTML|CSS"), ("e", 2, "CSS")], "e string, r int, t string")
    assert rows(reshape.item_matrix(df, ["e"], "r", "t", ["HTML", "CSS"], "|"), "HTML", "CSS") == [(1, 2)]


def test_an_empty_text_is_a_value(spark, rows):
    df = spark.createDataFrame([("a", ""), ("b", None)], "k string, v string")
    assert rows(aggregate.concat_distinct_by(df, ["k"], {"t": "v"}), "k", "t") == [("a", ""), ("b", None)]
    assert rows(aggregate.concat_all_by(df, ["k"], "v", "t", count="n"), "k", "t", "n") == [("a", "", 1), ("b", None, 1)]


def test_a_scorer_may_reorder_rows_but_not_lose_any(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    backwards = lambda v: pd.DataFrame({"s": v.str.upper()}).iloc[::-1]
    assert rows(incremental.enrich_unique(df, "t", backwards, "s string"), "t", "s") == [("a", "A"), ("b", "B"), ("c", "C")]
    short = lambda v: pd.DataFrame({"s": v[v != "a"].str.upper()})
    with pytest.raises(Exception, match="one row for each value"):
        incremental.enrich_unique(df, "t", short, "s string").collect()


def test_many_plain_terms_are_no_regex(spark):
    df = spark.createDataFrame([("x9.y",)], "t string").select(fn.match_any("t", [f"{k}." for k in range(40)]).alias("m"))
    assert df.first().m and "RLike" not in df._jdf.queryExecution().toString()


def test_values_off_the_list_have_a_place(spark, rows):
    df = spark.createDataFrame([("e", "a", 1), ("e", "z", 2), ("e", None, 4)], "k string, t string, n int")
    assert rows(reshape.pivot_wide(df, ["k"], "t", ["a", "b"], "n", other="rest"), "a", "b", "rest") == [(1, 0, 6)]
    assert rows(reshape.densify(df, ["k"], "t", ["a"], "n", other="rest"), "t", "n") == [("a", 1), ("rest", 6)]


def test_named_rows_beside_the_top_are_not_merged(spark, rows):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("b", 1)], "k string, n int")
    assert rows(ranking.top_n_global(df, "n", ["k"], 1, F.col("k").isin("a", "b")), "k", "n") == [("a", 5), ("b", 1), ("b", 1)]
