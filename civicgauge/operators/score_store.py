"""Scores that outlive a run: a table keyed by the digest of the text, so that only unseen texts are scored."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.session import durable
from civicgauge.sources.commits import Commits

DIGEST, BUCKET, RUN = "digest", "bucket", "scored_by"


class ScoreStore:
    """Scores of distinct texts in ``buckets`` parts by their digests.

    A run works through the parts that hold unseen texts. It claims a part, scores what is still unseen there, writes a folder
    and commits it; so a run that breaks off loses one part at most, the next one goes on from there, and two runs at a time do
    not pay for the same text, unless one takes longer than ``claim_minutes`` for a part. In that case the first score counts.
    A part is merged to one folder when it has more than ``most_folders``; old folders stay for those who read them.

    ``score`` takes a batch of distinct texts and returns the result columns, a row for each text under the text's index. A
    task calls it for ``rows_at_once`` texts at a time.
    """

    def __init__(self, spark: SparkSession, root: str, score: Callable[[pd.Series], pd.DataFrame], result: T.StructType | str, buckets: int = 64,
                 claim_minutes: float = 60, wait_seconds: float = 10, most_folders: int = 8) -> None:
        self.spark, self.root, self.score = spark, root.rstrip("/"), score
        self.result = T.StructType.fromDDL(result) if isinstance(result, str) else result
        self.schema = T.StructType([T.StructField(DIGEST, T.StringType()), *self.result.fields, T.StructField(RUN, T.StringType())])
        self.buckets, self.claim_minutes, self.wait_seconds, self.most_folders = buckets, claim_minutes, wait_seconds, most_folders
        self.commits = Commits(spark, self.root)

    def _bucket(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets)).cast("int")

    def read(self, bucket: int | None = None) -> DataFrame:
        """``digest``, the result columns and ``scored_by`` of every committed score, or of one part."""
        parts = self.commits.latest()[1]
        return self._read([f for b, fs in sorted(parts.items()) if bucket is None or b == str(bucket) for f in fs])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def unseen(self, df: DataFrame, column: str) -> DataFrame:
        """``digest``, ``value`` and ``bucket`` of each distinct text without a score. Null is no text."""
        texts = df.filter(F.col(column).isNotNull()).select(F.sha2(F.col(column), 256).alias(DIGEST), F.col(column).alias("value"))
        # The digests known are few columns wide, so what is shuffled of the store is narrow; the texts of seen ones are not made distinct.
        return texts.join(self.read().select(DIGEST), DIGEST, "left_anti").dropDuplicates([DIGEST]).withColumn(BUCKET, self._bucket(F.col(DIGEST)))

    def update(self, df: DataFrame, column: str, run: str = "", rows_at_once: int = 1000) -> int:
        """Score the unseen texts of ``df``; returns how many. ``run`` is noted beside each score."""
        run, owner = run or uuid.uuid4().hex, uuid.uuid4().hex
        todo = durable(self.unseen(df, column), "unseen-texts")
        waiting = list(todo.agg(F.sort_array(F.collect_set(BUCKET)).alias("b")).first()["b"])
        scored = 0
        while waiting:
            later = []
            for bucket in waiting:
                if not self.commits.claim(f"bucket-{bucket}", owner, self.claim_minutes):
                    later.append(bucket)
                    continue
                try:
                    scored += self._score_part(todo, bucket, run, rows_at_once)
                finally:
                    self.commits.release(f"bucket-{bucket}")
            if len(later) == len(waiting):
                time.sleep(self.wait_seconds)  # another run is at work on all that is left
            waiting = later
        return scored

    def _score_part(self, todo: DataFrame, bucket: int, run: str, rows_at_once: int) -> int:
        """One part. What another run scored meanwhile is left out before the call, and once more at the commit."""
        base, score, schema = self.commits.latest()[1].get(str(bucket), []), self.score, T.StructType(self.schema.fields[:-1])
        texts = todo.filter(F.col(BUCKET) == bucket).join(self._read(base).select(DIGEST), DIGEST, "left_anti").select(DIGEST, "value")

        def call(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), rows_at_once):
                    part = batch.iloc[at:at + rows_at_once]
                    found = score(part["value"])
                    if len(found) != len(part) or not found.index.sort_values().equals(part.index.sort_values()):
                        raise ValueError("the scorer must return one row for each value, with the values' index")
                    yield pd.concat([part[DIGEST], found.loc[part.index]], axis=1)

        folder = self._write(texts.mapInPandas(call, schema).withColumn(RUN, F.lit(run)), bucket)
        while True:
            held = self._replace(bucket, base, [*base, folder])
            if folder in held:
                break
            # The claim ran out and another run committed first: its scores count.
            base, folder = held, self._write(self._read([folder]).join(self._read(held).select(DIGEST), DIGEST, "left_anti"), bucket)
        if len(held) > self.most_folders:
            self._replace(bucket, held, [self._write(self._read(held), bucket)])
        return self._read([folder]).count()

    def _write(self, rows: DataFrame, bucket: int) -> str:
        folder = f"bucket={bucket}/{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.root}/{folder}")
        return folder

    def _replace(self, bucket: int, base: list[str], folders: list[str]) -> list[str]:
        """The part's folders after the commit; those of another run if it changed the part first."""
        name = str(bucket)
        return self.commits.commit(lambda parts: {**parts, name: folders} if parts.get(name, []) == base else None)[name]

    def enrich(self, df: DataFrame, column: str, run: str = "") -> DataFrame:
        """The rows with their scores; texts without one are scored first. Null texts have null scores."""
        self.update(df, column, run)
        digest = F.sha2(F.col(column), 256)
        return df.withColumn("__digest", digest).join(self.read().withColumnRenamed(DIGEST, "__digest"), "__digest", "left").drop("__digest")
