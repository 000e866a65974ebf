"""Files stacked by their headers, and files chosen before they are read."""

import gzip

import pytest

from civicgauge.sources import headers

SCHEMA = "id int, agency string, name string"


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture
def tree(tmp_path):
    put(tmp_path, "Cube March 2022/a.csv", 'id,agency,name\n1,EPA,"x, y"\n2,NA,z\n')
    put(tmp_path, "Cube March 2023/a.csv", '﻿name,"Id",AGENCY\nw,3,NOAA\n')
    put(tmp_path, "Cube March 2024/a.csv", '"",id,name\n"1",4,v\n"2",5\n')
    put(tmp_path, "Cube March 2024/empty.csv", "")
    return tmp_path


def test_columns_go_by_name_whatever_their_order(spark, rows, tree):
    df = headers.read_by_header(spark, str(tree), SCHEMA, index_column=True, year="year")
    assert df.dtypes == [("id", "int"), ("agency", "string"), ("name", "string"), ("year", "int")]
    assert rows(df) == [(1, "EPA", "x, y", 2022), (2, None, "z", 2022), (3, "NOAA", "w", 2023), (4, None, "v", 2024), (5, None, None, 2024)]


def test_unknown_lacking_and_doubled_columns(spark, rows, tmp_path):
    put(tmp_path, "a.csv", "id,name,extra\n1,x,9\n")
    with pytest.raises(ValueError, match="extra"):
        headers.read_by_header(spark, str(tmp_path), SCHEMA)
    assert rows(headers.read_by_header(spark, str(tmp_path), SCHEMA, unknown="drop")) == [(1, None, "x")]
    with pytest.raises(ValueError, match="agency"):
        headers.read_by_header(spark, str(tmp_path), SCHEMA, unknown="drop", required=["agency"])
    put(tmp_path, "a.csv", "id,name,Name\n1,x,y\n")
    with pytest.raises(ValueError, match="twice"):
        headers.read_by_header(spark, str(tmp_path), SCHEMA)


def test_aliases_and_names_with_signs(spark, rows, tmp_path):
    put(tmp_path, "a [1].csv", " I.D. , Primary-Agency name\n7,EPA\n")
    found = headers.read_by_header(spark, str(tmp_path), SCHEMA, aliases={"primary agency name": "agency", "I.D.": "id"})
    assert rows(found) == [(7, "EPA", None)]


def test_compressed_files_and_line_breaks_in_headers(spark, rows, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as file:
        file.write("name,id\nx,1\n")
    assert headers.read_header(spark, str(tmp_path / "a.csv.gz")) == ("name", "id")
    assert rows(headers.read_by_header(spark, str(tmp_path), SCHEMA, glob="*.gz")) == [(1, None, "x")]
    put(tmp_path, "b.csv", 'id,"agency"\n1,x\n')
    put(tmp_path, "c.csv", '"the\nname",id\nx,1\n')
    assert headers.read_header(spark, str(tmp_path / "c.csv")) == ("the\nname", "id")


def test_a_file_that_changes_under_the_scan_is_told(spark, tmp_path):
    put(tmp_path, "a.csv", "id,agency,name\n1,a,b\n")
    df = headers.read_by_header(spark, str(tmp_path), SCHEMA)
    put(tmp_path, "a.csv", "id,name,agency\n1,a,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        df.collect()


def test_only_files_of_the_asked_years_are_in_the_scan(spark, rows, tree):
    put(tree, "Cube March 2023/b.csv", "id,agency,name\n9,x,y\n")
    df = headers.read_by_header(spark, str(tree), SCHEMA, index_column=True, year="year", years=[2022, 2023], prefer={2023: "b.csv"})
    assert sorted(p.rsplit("/", 2)[-2:] for p in df.inputFiles()) == [["Cube%20March%202022", "a.csv"], ["Cube%20March%202023", "b.csv"]]
    assert rows(df, "id", "year") == [(1, 2022), (2, 2022), (9, 2023)]
    none = headers.read_by_header(spark, str(tree), SCHEMA, year="year", years=[1999])
    assert none.columns == ["id", "agency", "name", "year"] and none.count() == 0


def test_years_of_folders():
    assert headers.folder_year("file:/d/Cube March 2023/FACTDATA.TXT") == 2023
    assert headers.folder_year("file:/d/Cube March 2023/DTocc.txt/part-0.csv") == 2023
    assert headers.folder_year("file:/d/20231/x.csv") is None


def test_a_folder_without_year_stops_the_job(spark, tmp_path):
    put(tmp_path, "cube/a.csv", "id\n1\n")
    with pytest.raises(ValueError, match="no year"):
        headers.read_by_header(spark, str(tmp_path / "cube"), "id int", year="year")
