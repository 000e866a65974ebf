import pytest
from pyspark.sql import functions as F

from civicgauge.session import durable, scratch_path, shared_folder
from civicgauge.sources import readers, writers


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_durable_cuts_the_lineage(spark, rows):
    df = durable(spark.range(3).select((F.col("id") * 2).alias("v")))
    assert rows(df) == [(0,), (2,), (4,)]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_csv_reads_index_column_na_and_quotes(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text('"",name,n\n"1","A ""x"", b\nnew line",5\n"2",NA,NA\n')
    df = readers.read_table_csv(spark, str(tmp_path / "t.csv"), "name string, n int", index_column=True)
    assert rows(df) == [(None, None), ('A "x", b\nnew line', 5)]


def test_ragged_rows(spark, rows, tmp_path):
    (tmp_path / "t.txt").write_text('a,b,c\n1,"x, y",3\n2\n')
    assert rows(readers.read_ragged(spark, str(tmp_path / "t.txt"), "a int, b string, c int")) == [(1, "x, y", 3), (2, None, None)]


def test_many_files_years_and_picked_files(spark, rows, tmp_path):
    for folder, name, n in (("Cube_March2023", "FACTDATA_MAR2023.TXT", 1), ("Cube_March2024", "FACTDATA_MAR2024.TXT", 2),
                            ("Cube_March2024", "FACTDATA_SEP2024.TXT", 3), ("Cube_March2024", "DTocc.txt", 4)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"N\n{n}\n")
    df = readers.with_path_year(readers.read_many(spark, str(tmp_path), "N int", glob="*FACTDATA*"))
    assert rows(df) == [(1, 2023), (2, 2024), (3, 2024)]
    assert rows(readers.pick_files(df, {2024: "FACTDATA_MAR2024.TXT"})) == [(1, 2023), (2, 2024)]
    assert rows(readers.year_range(df)) == [(2023, 2024)]


def test_json_pages(spark, rows, tmp_path):
    (tmp_path / "data_page3.json").write_text('{"R": {"Items": [{"Id": "a", "D": {"T": "x"}}, {"Id": "b", "D": {"T": null}}]}}')
    (tmp_path / "data_page4.json").write_text('{"R":\n {"Items": []}}')
    schema = "R struct<Items: array<struct<Id: string, D: struct<T: string>>>>"
    df = readers.read_json_pages(spark, str(tmp_path), schema, "R.Items")
    assert rows(df.select("Id", "D.T", "page")) == [("a", "x", 3), ("b", None, 3)]


def test_literal_table_has_a_known_size(spark, rows):
    df = readers.literal_table(spark, [("a", 1), ("b", None)], "k string, n int")
    assert rows(df) == [("a", 1), ("b", None)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_csv_and_partitioned_writes(spark, rows, tmp_path):
    df = spark.createDataFrame([("a, b", 1, "x"), (None, 2, "y")], "t string, n int, k string")
    writers.write_table_csv(df, str(tmp_path / "tsv"), separator="\t")
    assert rows(readers.read_table_csv(spark, str(tmp_path / "tsv"), "t string, n int, k string", separator="\t")) == rows(df)
    path = str(tmp_path / "parts")
    writers.write_partitioned(df, path, ["k"])
    writers.write_partitioned(df.filter("k = 'x'").withColumn("n", F.lit(9)), path, ["k"])
    writers.write_partitioned(df, path, ["k"], mode="ignore")
    assert rows(spark.read.parquet(path), "t", "n", "k") == [(None, 2, "y"), ("a, b", 9, "x")]


def test_snapshots(spark, rows, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        writers.snapshot_read(spark, root)
    assert writers.snapshot_write(spark.range(1), root) == 1
    assert writers.snapshot_write(writers.snapshot_read(spark, root).union(spark.range(5, 6)), root) == 2
    (tmp_path / "snap" / "version=3").mkdir()  # an unfinished version is not read
    assert rows(writers.snapshot_read(spark, root)) == [(0,), (5,)]
    assert rows(writers.snapshot_read(spark, root, version=1)) == [(0,)]


def test_year_of_folders_with_blanks(spark, rows, tmp_path):
    for year in (2022, 2023):
        (tmp_path / f"Cube March {year}").mkdir()
        (tmp_path / f"Cube March {year}" / "a.csv").write_text("v\n1\n")
    found = readers.with_path_year(readers.read_many(spark, str(tmp_path), "v int", multi_line=False))
    assert rows(found, "v", "year") == [(1, 2022), (1, 2023)]


def test_a_folder_without_year_stops_the_job(spark, tmp_path):
    (tmp_path / "Cube").mkdir()
    (tmp_path / "Cube" / "a.csv").write_text("v\n1\n")
    with pytest.raises(Exception, match="no year"):
        readers.with_path_year(readers.read_many(spark, str(tmp_path / "Cube"), "v int", multi_line=False)).collect()


def test_a_claimed_version_is_not_written_again(spark, tmp_path):
    root = str(tmp_path / "s")
    assert writers.snapshot_write(spark.range(1), root) == 1
    (tmp_path / "s" / "_claims" / "2").write_text("")  # another writer is at it
    assert writers.snapshot_write(spark.range(2), root) == 3
    assert writers.snapshot_read(spark, root).count() == 2
