"""The daily pull as a stream: files land in a folder, first-seen records are appended to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from civicgauge.operators.incremental import first_seen
from civicgauge.session import durable

BATCH, RUN = "batch_id", "run_id"


def read_store(spark: SparkSession, store: str, schema: T.StructType | str) -> DataFrame:
    """The store as appended so far, with the run (a checkpoint's id) and batch of each row; empty before the first batch."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_batch = T.StructType([*fields.fields, T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).parquet(store)


def append_landed_pulls(
    spark: SparkSession, landing: str, schema: T.StructType | str, store: str, checkpoint: str, key: str, file_format: str = "json",
    max_files: int | None = None,
) -> StreamingQuery:
    """Process the files that landed since the last run, then stop (run it on any schedule).

    Every micro-batch writes its own folder, named by the id in the checkpoint and the batch, and compares with all rows
    outside that folder. If a batch is replayed after a failure it overwrites its own folder with the same rows, so the
    store never holds a record twice; a new checkpoint, or one begun anew after a loss, has another id and so neither
    replaces nor ignores what is stored. Rows of one new id in the same batch all stay, which ``dropDuplicates`` on the id
    would not do; nor does this keep ids as streaming state.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def append(pull: DataFrame, batch: int) -> None:
        spark = pull.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("the stream's id is not known")
        earlier = read_store(spark, store, schema).filter((F.col(RUN) != run) | (F.col(BATCH) != batch)).drop(RUN, BATCH)
        pull = durable(pull, "micro-batch")  # the landed files are read once
        first_seen(pull, earlier, key).write.mode("overwrite").parquet(f"{store}/{RUN}={run}/{BATCH}={batch}")

    return reader.load(landing).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
