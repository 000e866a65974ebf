import json

from pyspark.sql import functions as F

from civicgauge.operators.incremental import append_first_seen
from civicgauge.streaming.first_seen import BATCH, append_landed_pulls, read_store

SCHEMA = "id string, v int"


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in records))


def run(spark, root, name="checkpoint"):
    append_landed_pulls(
        spark, str(root / "landing"), SCHEMA, str(root / "store"), str(root / name), "id").awaitTermination()
    return read_store(spark, str(root / "store"), SCHEMA)


def test_two_pulls_equal_the_batch_result(spark, rows, tmp_path):
    first, second = [("a", 1), ("a", 2), ("b", 3), (None, 4)], [("a", 9), ("c", 5), ("c", 6), (None, 7)]
    land(tmp_path / "landing", "p1.json", first)
    assert rows(run(spark, tmp_path), "id", "v") == [(None, 4), ("a", 1), ("a", 2), ("b", 3)]
    land(tmp_path / "landing", "p2.json", second)
    streamed = rows(run(spark, tmp_path), "id", "v")
    batch = append_first_seen(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA), "id")
    assert streamed == rows(batch)
    assert rows(run(spark, tmp_path), "id", "v") == streamed  # a run without new files changes nothing


def test_a_replayed_batch_does_not_duplicate(spark, rows, tmp_path):
    land(tmp_path / "landing", "p1.json", [("a", 1), ("b", 2)])
    once = rows(run(spark, tmp_path), "id", "v", BATCH)
    again = rows(run(spark, tmp_path, "lost-checkpoint"), "id", "v", BATCH)  # batch 0 runs once more
    assert once == again == [("a", 1, 0), ("b", 2, 0)]


def test_store_is_empty_before_the_first_batch(spark, tmp_path):
    assert read_store(spark, str(tmp_path / "none"), SCHEMA).filter(F.col(BATCH) < 1).count() == 0


def test_a_second_checkpoint_keeps_what_is_stored(spark, rows, tmp_path):
    land(tmp_path / "landing", "p1.json", [("a", 1), ("b", 2)])
    run(spark, tmp_path)
    (tmp_path / "landing" / "p1.json").rename(tmp_path / "p1.json")
    land(tmp_path / "landing", "p2.json", [("b", 7), ("c", 3)])
    assert rows(run(spark, tmp_path, "second"), "id", "v") == [("a", 1), ("b", 2), ("c", 3)]
