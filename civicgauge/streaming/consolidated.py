"""The daily pull as a stream that consolidates: search hits become counts by record, for the pull that saw it first."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from civicgauge.operators.aggregate import texts_by_count
from civicgauge.operators.joins import join_null_safe
from civicgauge.session import durable
from civicgauge.sources.commits import Commits

BUCKET, LANDED, COUNT = "bucket", "landed", "n"


class ConsolidatedStore:
    """Hits (id, term, pull, landed file, count) and records (id, pull, lasting columns), in ``buckets`` parts by id.

    An id belongs to the pull that brought it first, of several in one batch the smallest; what later pulls bring of it is
    left out. Hits of a pull that comes in several batches are added up. A micro-batch reads the parts its ids are in, id and
    pull only, writes folders of its own and commits them; a batch that runs again writes the same folders, or finds itself
    committed. A file that lands again under a new checkpoint counts once, as counts are kept by file. ``compact`` merges the
    folders of each part beside a running batch: what that commits meanwhile stays beside the merged folder. One stream at a
    time may feed a store. Null is an id as any other.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, term: str, pull: str, volatile: Sequence[str] = (), buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.term, self.pull, self.buckets = spark, root.rstrip("/"), key, term, pull, buckets
        fields = {f.name: f for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields}
        self.lasting = [c for c in fields if c not in (term, *volatile)]
        self.tables = {
            "hits": T.StructType([fields[key], fields[term], fields[pull], T.StructField(LANDED, T.LongType()), T.StructField(COUNT, T.LongType())]),
            "records": T.StructType([fields[c] for c in self.lasting])}
        self.commits = Commits(spark, self.root)

    # ---- reading ----

    def folders(self, table: str, parts: Iterable[int] | None = None) -> list[str]:
        """Committed folders of a table, of all parts or some."""
        held = self.commits.latest()[1].get("parts", {})
        asked = sorted(map(int, held)) if parts is None else parts
        return [f"{self.root}/{table}/{token}/{BUCKET}={b}" for b in asked for token in held.get(str(b), [])]

    def _read(self, table: str, parts: Iterable[int] | None = None) -> DataFrame:
        paths = self.folders(table, parts)
        schema = self.tables[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        """Every distinct record, with its pull."""
        return self._read("records").distinct()

    def term_counts(self) -> DataFrame:
        """How often each term found each id in its pull: (id, term, n). One row for each distinct term, however many records."""
        return self._once(self._read("hits")).groupBy(self.key, self.term).agg(F.sum(COUNT).alias(COUNT))

    def _once(self, hits: DataFrame) -> DataFrame:
        return hits.groupBy(self.key, self.term, self.pull, LANDED).agg(F.max(COUNT).alias(COUNT))

    def consolidated(self, name: str = "all_keywords", repeats: bool = True) -> DataFrame:
        """Each record with the terms that found its id as one text, with or without repeats."""
        counts = self.term_counts()
        terms = texts_by_count(counts if repeats else counts.withColumn(COUNT, F.lit(1)), [self.key], self.term, COUNT, name)
        return join_null_safe(self.records(), terms, [self.key], "left")

    # ---- writing ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def merge(self, rows: DataFrame, run: str, batch: int) -> None:
        """Take in one micro-batch: the columns of the schema and ``landed``, the file each row came from."""
        if self.commits.latest()[1].get("runs", {}).get(run, -1) >= batch:
            return
        rows = durable(rows.withColumn(BUCKET, self._bucket()), "micro-batch")
        parts = rows.agg(F.collect_set(BUCKET).alias("b")).first()["b"]
        known = self._read("records", sorted(parts)).groupBy(self.key).agg(F.min(self.pull).alias("__known"))
        first = rows.groupBy(self.key).agg(F.min(self.pull).alias("__first"))
        first = join_null_safe(first, known, [self.key], "left").select(self.key, F.coalesce("__known", "__first").alias("__pull"))
        taken = join_null_safe(rows, first, [self.key], "left").filter(F.col(self.pull).eqNullSafe(F.col("__pull"))).drop("__pull")
        token = f"{run}-{batch}"
        self._write(taken.groupBy(BUCKET, self.key, self.term, self.pull, LANDED).agg(F.count(F.lit(1)).alias(COUNT)), "hits", token)
        self._write(taken.select(BUCKET, *self.lasting).distinct(), "records", token)
        filled = self._filled(token)

        def add(state: dict) -> dict:
            held = state.get("parts", {})
            return {"runs": {**state.get("runs", {}), run: batch}, "parts": {
                **held, **{b: [*held.get(b, []), token] for b in filled if token not in held.get(b, [])}}}

        self.commits.commit(add)

    def _write(self, rows: DataFrame, table: str, token: str) -> None:
        rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{table}/{token}")

    def _filled(self, token: str) -> list[str]:
        """Parts that a batch has rows in, by the folders it wrote."""
        path = self.commits.hadoop.Path(f"{self.root}/records/{token}")
        names = [s.getPath().getName() for s in self.commits.files.listStatus(path)]
        return sorted(n.removeprefix(f"{BUCKET}=") for n in names if n.startswith(f"{BUCKET}="))

    def compact(self, most_folders: int = 4) -> list[int]:
        """Merge the folders of parts that have more than ``most_folders``; returns these parts. Old folders stay for readers."""
        held = {b: tokens for b, tokens in self.commits.latest()[1].get("parts", {}).items() if len(tokens) > most_folders}
        if not held:
            return []
        parts, token = sorted(map(int, held)), f"merged-{uuid.uuid4().hex}"
        self._write(self._once(self._read("hits", parts)).withColumn(BUCKET, self._bucket()), "hits", token)
        self._write(self._read("records", parts).distinct().withColumn(BUCKET, self._bucket()), "records", token)
        done: list[int] = []

        def swap(state: dict) -> dict:
            done.clear()
            for b, merged in held.items():
                now = state["parts"][b]
                if now[:len(merged)] == merged:  # else another run has merged this part
                    state["parts"][b] = [token, *now[len(merged):]]
                    done.append(int(b))
            return state

        self.commits.commit(swap)
        return sorted(done)


def consolidate_landed_pulls(store: ConsolidatedStore, landing: str, schema: T.StructType | str, checkpoint: str, file_format: str = "json", max_files: int | None = None) -> StreamingQuery:
    """Take in the files that landed since the last run, then stop (run it on any schedule)."""
    reader = store.spark.readStream.schema(schema).format(file_format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def take(rows: DataFrame, batch: int) -> None:
        run = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("the stream's id is not known")
        store.merge(rows, run, batch)

    rows = reader.load(landing)
    return rows.select("*", F.xxhash64("_metadata.file_path").alias(LANDED)).writeStream.foreachBatch(take) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
