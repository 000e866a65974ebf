"""Tables that several runs add to: commits, scores, consolidated pulls, keys that are absent."""

import json

import pytest
from pyspark.sql import functions as F

from civicgauge.operators.incremental import append_first_seen, consolidate_hits, hit_counts
from civicgauge.operators.ordered import number_rows, running
from civicgauge.operators.score_store import ScoreStore
from civicgauge.sources import writers
from civicgauge.sources.commits import Commits
from civicgauge.streaming.consolidated import ConsolidatedStore, consolidate_landed_pulls
from tests.test_plan_shapes import plan


# ---- commits ----

def test_a_commit_that_comes_second_sees_the_first(spark, tmp_path):
    one, two = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    seen = []

    def slow(state):
        if not seen:
            two.commit(lambda s: {**s, "b": 2})
        seen.append(dict(state))
        return {**state, "a": 1}

    assert one.commit(slow) == {"a": 1, "b": 2} and seen == [{}, {"b": 2}]
    assert one.commit(lambda s: None) == two.latest()[1] == {"a": 1, "b": 2}
    for i in range(30):
        one.commit(lambda s: {"n": i})
    assert two.latest() == (32, {"n": 29}) and len(list((tmp_path / "_commits").glob("[0-9]*"))) == 20


def test_claims_end(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    assert commits.claim("x", "me", 10) and not commits.claim("x", "you", 10)
    assert commits.claim("x", "you", -1)  # it ran out
    commits.release("x")
    assert commits.claim("x", "me", 10)


# ---- scores ----

@pytest.fixture
def scorer(tmp_path):
    """A scorer that notes the texts it is called for, and breaks on one text while a file says so."""
    calls, broken = str(tmp_path / "calls"), tmp_path / "broken"

    def score(texts):
        if broken.exists() and (texts == broken.read_text()).any():
            raise RuntimeError("the scorer is not there")
        with open(calls, "a") as file:
            file.writelines(t + "\n" for t in texts)
        return texts.str.len().rename("size").to_frame().iloc[::-1]

    return score, lambda: sorted(open(calls).read().split()) if (tmp_path / "calls").exists() else [], broken


def test_each_text_is_scored_in_one_run_only(spark, rows, tmp_path, scorer):
    score, calls, _ = scorer
    store = ScoreStore(spark, str(tmp_path / "store"), score, "size bigint", buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None)], "id int, t string")
    second = spark.createDataFrame([(5, "bb"), (6, "ccc"), (7, "a"), (8, "dddd")], "id int, t string")
    assert rows(store.enrich(first, "t", "one"), "id", "size", "scored_by") == [(1, 1, "one"), (2, 2, "one"), (3, 2, "one"), (4, None, None)]
    assert calls() == ["a", "bb"]
    assert store.update(second, "t", "two") == 2 and store.update(second, "t", "three") == 0
    assert calls() == ["a", "bb", "ccc", "dddd"]
    assert rows(store.enrich(second, "t"), "id", "size", "scored_by") == [(5, 2, "one"), (6, 3, "two"), (7, 1, "one"), (8, 4, "two")]
    assert ScoreStore(spark, str(tmp_path / "none"), score, "size bigint").enrich(first.limit(0), "t").count() == 0


def test_a_run_that_broke_off_goes_on(spark, rows, tmp_path, scorer):
    score, calls, broken = scorer
    store = ScoreStore(spark, str(tmp_path / "store"), score, "size bigint", buckets=6)
    texts = spark.createDataFrame([("t" * n,) for n in range(1, 13)], "t string")
    broken.write_text("t" * 7)
    with pytest.raises(Exception, match="not there"):
        store.update(texts, "t")
    kept = store.read().count()
    assert 0 < kept < 12
    broken.unlink()
    assert store.update(texts, "t") == 12 - kept and store.read().count() == 12
    assert rows(store.read(), "size") == [(n,) for n in range(1, 13)]


def test_of_two_runs_that_meet_the_first_commit_counts(spark, rows, tmp_path, scorer):
    score, _, _ = scorer
    root, texts = str(tmp_path / "store"), spark.createDataFrame([("a",), ("bb",)], "t string")
    other = ScoreStore(spark, root, score, "size bigint", buckets=1)
    store = ScoreStore(spark, root, score, "size bigint", buckets=1)
    write = store._write

    def late(rows_, bucket):  # the other run commits between this one's scoring and its commit
        folder = write(rows_, bucket)
        store._write = write
        other.commits.release("bucket-0")
        other.update(texts.limit(1), "t", "other")
        return folder

    store._write = late
    store.update(texts, "t", "own")
    found = rows(store.read(), "size", "scored_by")
    assert len(found) == 2 and [s for s, _ in found] == [1, 2] and sorted(r for _, r in found) == ["other", "own"]


def test_folders_of_a_part_are_merged(spark, tmp_path, scorer):
    store = ScoreStore(spark, str(tmp_path / "store"), scorer[0], "size bigint", buckets=1, most_folders=2)
    for n in range(1, 5):
        store.update(spark.createDataFrame([("t" * n,)], "t string"), "t")
        assert len(store.commits.latest()[1]["0"]) <= 2
    assert store.read().count() == 4


def test_a_claimed_part_waits_and_a_bad_scorer_is_told(spark, tmp_path, scorer):
    texts = spark.createDataFrame([("a",)], "t string")
    store = ScoreStore(spark, str(tmp_path / "store"), scorer[0], "size bigint", buckets=1, claim_minutes=0.02, wait_seconds=0.5)
    assert store.commits.claim("bucket-0", "another run", 1)
    assert store.update(texts, "t") == 1  # after the other's claim has run out
    bad = ScoreStore(spark, str(tmp_path / "bad"), lambda t: t.str.len().rename("size").to_frame().iloc[:0], "size bigint", buckets=1)
    with pytest.raises(Exception, match="one row for each value"):
        bad.update(texts, "t")


# ---- consolidated pulls ----

SCHEMA = "id string, term string, pull int, v int, page int"


@pytest.fixture
def pulls(spark, tmp_path):
    store = ConsolidatedStore(spark, str(tmp_path / "store"), SCHEMA, "id", "term", "pull", ["page"], buckets=8)

    def run(name=None, records=(), checkpoint="checkpoint"):
        (tmp_path / "landing").mkdir(exist_ok=True)
        if name:
            (tmp_path / "landing" / name).write_text("\n".join(json.dumps(dict(zip(("id", "term", "pull", "v", "page"), r))) for r in records))
        consolidate_landed_pulls(store, str(tmp_path / "landing"), SCHEMA, str(tmp_path / checkpoint)).awaitTermination()
        return store

    return run


ONE = [("a", "x", 1, 1, 1), ("a", "y", 1, 1, 2), ("a", "x", 1, 2, 3), ("b", "x", 1, 5, 4), (None, "x", 1, 6, 5)]
TWO = [("a", "z", 2, 9, 1), ("c", "x", 2, 7, 2), (None, "y", 2, 8, 3)]
MORE_OF_TWO = [("c", "x", 2, 7, 9), ("c", "w", 2, 7, 9), ("b", "w", 2, 5, 1)]


def test_pulls_equal_the_batch_job(spark, rows, pulls):
    pulls("1.json", ONE)
    pulls("2.json", TWO)
    store = pulls("3.json", MORE_OF_TWO)
    first, second = (spark.createDataFrame(r, SCHEMA) for r in (ONE, TWO + MORE_OF_TWO))
    batch = append_first_seen(*[consolidate_hits(p, ["id"], "term", volatile=["page"]) for p in (first, second)], "id").filter("id IS NOT NULL")
    assert rows(store.consolidated().filter("id IS NOT NULL"), "id", "pull", "v", "all_keywords") == rows(batch, "id", "pull", "v", "all_keywords")
    assert rows(store.term_counts()) == [(None, "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("c", "w", 1), ("c", "x", 2)]
    assert rows(store.consolidated(repeats=False).filter("id = 'c'"), "all_keywords") == [("w, x",)]


def test_what_lands_again_counts_once(rows, pulls):
    pulls("1.json", ONE)
    store = pulls("2.json", TWO)
    before = rows(store.consolidated()), rows(store.term_counts())
    pulls(checkpoint="lost-checkpoint")
    assert (rows(store.consolidated()), rows(store.term_counts())) == before


def test_a_batch_reads_the_parts_of_its_ids(rows, pulls):
    store = pulls("1.json", [(f"id{i}", "x", 1, i, 1) for i in range(60)])
    pulls("2.json", [(f"id{i}", "x", 2, i, 1) for i in range(60, 62)])
    everything = len(store.folders("records"))
    parts = [r[0] for r in rows(store.spark.createDataFrame([("id60",), ("id61",)], "id string").select(store._bucket()).distinct())]
    assert len(store.folders("records", parts)) <= 2 * len(parts) < everything


def test_compaction_beside_a_batch_and_a_replay(spark, rows, pulls, monkeypatch):
    for i, records in enumerate([ONE, TWO, MORE_OF_TWO]):
        store = pulls(f"{i}.json", records)
    want, folders = rows(store.consolidated()), len(store.folders("hits"))
    write, batch = store._write, spark.createDataFrame([(*r, 77) for r in [("d", "x", 3, 1, 1), ("a", "q", 3, 1, 1)]], SCHEMA + ", landed bigint")

    def while_compacting(rows_, table, token):  # a batch commits while the merged folders are written
        monkeypatch.setattr(store, "_write", write)
        write(rows_, table, token)
        store.merge(batch, "another run", 0)

    monkeypatch.setattr(store, "_write", while_compacting)
    assert store.compact(1)
    assert len(store.folders("hits")) < folders + 2
    assert rows(store.consolidated().filter("v <> 1 OR id <> 'd'")) == want and rows(store.term_counts().filter("id = 'd'")) == [("d", "x", 1)]
    store.merge(batch, "another run", 0)  # a replay of a batch that is committed
    assert rows(store.term_counts().filter("id = 'd'")) == [("d", "x", 1)] and store.compact(8) == []


def test_a_batch_that_broke_off_before_its_commit_runs_again(spark, rows, pulls, monkeypatch):
    store = pulls("1.json", ONE)
    batch = spark.createDataFrame([("n", "x", 2, 1, 1, 5)], SCHEMA + ", landed bigint")
    monkeypatch.setattr(store.commits, "commit", lambda change: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.merge(batch, "run", 0)
    monkeypatch.undo()
    assert rows(store.term_counts().filter("id = 'n'")) == []
    store.merge(batch, "run", 0)
    assert rows(store.term_counts().filter("id = 'n'")) == [("n", "x", 1)]


def test_terms_of_an_id_with_most_hits_stay_few(spark, rows):
    hits = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).cast("string").alias("term"), F.col("id").alias("day"))
    terms, records = hit_counts(hits, ["k"], "term")
    assert terms.filter("k = 1").count() == 3 and records.filter("k = 1").count() == 12_000
    assert terms.agg(F.sum("n")).first()[0] == 20_000


# ---- absent keys ----

def test_absent_keys_only(spark, rows, tmp_path):
    path, columns = str(tmp_path / "t"), "v int, k string, n int"
    first = spark.createDataFrame([(1, "a/b", 1), (2, None, 1)], columns)
    every = spark.createDataFrame([(8, "a/b", 1), (9, "a/b", 2), (8, None, 1), (7, "c d", None)], columns)
    there = sorted([("a/b", "1"), (None, "1")], key=str)
    assert sorted(writers.write_absent(first, path, ["k", "n"]), key=str) == there == writers.keys_written(spark, path, ["k", "n"])
    assert sorted(writers.write_absent(every, path, ["k", "n"]), key=str) == sorted([("a/b", "2"), ("c d", None)], key=str)
    assert rows(spark.read.schema(columns).parquet(path), "v", "k", "n") == [(1, "a/b", 1), (2, None, 1), (7, "c d", None), (9, "a/b", 2)]
    assert writers.write_absent(every, path, ["k", "n"]) == [] and not list((tmp_path / "t").glob("_absent*"))


def test_keys_that_are_there_are_not_scanned(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "t")
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "v int, k int")
    df.write.partitionBy("k").parquet(source)
    given = spark.read.schema("v int, k int").parquet(source)
    writers.write_absent(given.filter("k < 3"), path, ["k"])
    rest = writers.without_keys(given, ["k"], writers.keys_written(spark, path, ["k"]))
    assert "PartitionFilters: [isnotnull(k" not in plan(rest) and "NOT k" in plan(rest) and rest.distinct().count() == 20
    assert len({p.rsplit("/", 2)[-2] for p in [r[0] for r in rest.select("_metadata.file_path").distinct().collect()]}) == 2


def test_a_key_that_broke_off_is_written_by_the_next_run(spark, rows, tmp_path):
    path = tmp_path / "t"
    (path / "_absent-of-a-lost-run" / "k=1").mkdir(parents=True)
    df = spark.createDataFrame([(5, 1), (6, 2)], "v int, k int")
    assert writers.write_absent(df, str(path), ["k"]) == [("1",), ("2",)]
    assert rows(spark.read.parquet(str(path)), "v", "k") == [(5, 1), (6, 2)]


# ---- running values ----

@pytest.mark.parametrize("partitions", [1, 9])
def test_running_values_over_ranges(spark, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [("a" if i % 3 else None if i % 2 else "b", i, None if i % 7 == 0 else i) for i in range(100)]
        df = spark.createDataFrame(data, "g string, o int, v bigint")
        found = rows(running(df, ["g"], ["o"], {
            "total": ("sum", F.col("v")), "least": ("min", -F.col("v")), "most": ("max", F.col("v")), "mixed": ("bit_xor", F.col("v"))}))
        numbered = rows(number_rows(df, [], [F.desc("o")]), "o", "number")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for g in ("a", "b", None):
        so_far = []
        for _, o, v in sorted(r for r in data if r[0] == g):
            so_far += [v] if v is not None else []
            mixed = None
            for x in so_far:
                mixed = x if mixed is None else mixed ^ x
            want.append((g, o, v, sum(so_far) if so_far else None, -max(so_far) if so_far else None, max(so_far, default=None), mixed))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert numbered == [(o, 100 - o) for o in range(100)]
    assert number_rows(df.limit(0), ["g"], ["o"]).count() == 0
