"""What reaches the scan, how often a large table is read, and what the library never does."""

import re
from pathlib import Path

import pytest

from __spark_entry__ import queries

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")

ONE_SCAN = [
    "tech_ratio", "workforce_mix", "tech_pct_latest", "department_rollup", "supervisor_share", "grade_mix", "employment_trends",
    "occupation_profile", "largest_units", "core_stats", "duplicate_report", "key_consistency",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ONE_SCAN)
def test_fact_table_is_read_once(spark, name):
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan(queries()[name](spark, FOLDER)))) <= 1


@needs_data
@pytest.mark.parametrize("name", ["tech_pct_latest", "entity_display_order", "language_top5"])
def test_ranks_are_not_numbered_in_one_task(spark, name):
    assert "SinglePartition" not in plan(queries()[name](spark, FOLDER))


@needs_data
@pytest.mark.parametrize("name", ["tech_ratio", "share_by_quarter", "repo_activity", "language_top5", "append_first_seen", "indicator_summary"])
def test_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|NestedLoop", plan(queries()[name](spark, FOLDER)))


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(queries()["row_filters"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_quantity,5.0)" in text and "In(l_returnflag, [A,R])" in text
    text = plan(queries()["duplicate_report"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


@needs_data
def test_top_n_is_limited_before_the_shuffle(spark):
    text = plan(queries()["top_n_per_group"](spark, FOLDER))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


@pytest.mark.parametrize("pattern", [
    r"\.collect\(\)", r"\.toPandas\(", r"localCheckpoint", r"broadcast\(", r"crossJoin", r"\.rdd\b", r"\bF\.udf\b", r"\.cache\(\)", r"\.persist\(",
])
def test_library_avoids(pattern):
    # The text corpus operators are apart: they broadcast model tables of a fixed size and say so.
    found = [f.name for f in (ROOT / "civicgauge").rglob("*.py") if "llm" not in f.parts and re.search(pattern, f.read_text())]
    assert found == []
