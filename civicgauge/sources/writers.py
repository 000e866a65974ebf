"""Sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table_csv(df: DataFrame, path: str, separator: str = ",", null_text: str = "NA", mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("sep", separator).option("nullValue", null_text) \
        .option("escape", '"').csv(path)


def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], mode: str = "dynamic", file_format: str = "parquet", rows_per_file: int = 5_000_000,
) -> None:
    """One folder per key. ``ignore`` leaves an existing table alone, ``dynamic`` replaces only the keys written, ``absent``

    writes only the keys that the table lacks (see ``write_absent``).

    Rows of a key are brought together for few, large files; adaptive execution splits a key that is too large for one
    task, and ``rows_per_file`` bounds each file.
    """
    if mode == "absent":
        write_absent(df, path, keys, file_format, rows_per_file)
        return
    rows = df.hint("rebalance", *[F.col(k) for k in keys])
    writer = rows.write.partitionBy(*keys).format(file_format).option("maxRecordsPerFile", rows_per_file)
    if file_format == "csv":
        writer = writer.option("header", True)
    if mode == "dynamic":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode(mode).save(path)


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def keys_written(spark: SparkSession, path: str, keys: Sequence[str]) -> list[tuple[str | None, ...]]:
    """Keys that a table of folders holds, as text, from the folders' names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path("/".join([path.rstrip("/"), *[f"{k}=*" for k in keys]]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    parts = [status.getPath().toString().split("/")[-len(keys):] for status in found]
    return sorted([tuple(_value(p) for p in part) for part in parts], key=str)


def _value(folder: str) -> str | None:
    value = folder.split("=", 1)[1]
    return None if value == NO_VALUE else unquote(value)


def without_keys(df: DataFrame, keys: Sequence[str], written: Sequence[tuple[str | None, ...]]) -> DataFrame:
    """Rows of other keys than these. The test is one on the key columns, so it reaches the scan of ``df``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def same(key: str, value: str | None) -> Column:
        return F.col(key).isNull() if value is None else F.col(key) == F.lit(value).cast(kinds[key])

    if not written:
        return df
    if len(keys) == 1:
        key, values = F.col(keys[0]), [v for v, in written]
        other = ~key.isin(*[F.lit(v).cast(kinds[keys[0]]) for v in values if v is not None])
        return df.filter(other if None in values else key.isNull() | other)
    held = reduce(Column.__or__, [reduce(Column.__and__, [same(k, v) for k, v in zip(keys, value)]) for value in written])
    return df.filter(~F.coalesce(held, F.lit(False)))


def write_absent(
    df: DataFrame, path: str, keys: Sequence[str], file_format: str = "parquet", rows_per_file: int = 5_000_000,
) -> list[tuple[str | None, ...]]:
    """Write the keys that the table at ``path`` lacks, and return them. Keys it has are neither read nor touched.

    All new keys are written beside the table, and then each folder is moved into its place. So a key is there whole or not
    at all, a job that breaks off leaves the keys it has moved, and when it runs again it does the others. If another job has
    put a key in its place meanwhile, that one stays.
    """
    spark = df.sparkSession
    hadoop, beside = spark._jvm.org.apache.hadoop.fs, f"{path.rstrip('/')}/_absent-{uuid.uuid4().hex}"
    write_partitioned(without_keys(df, keys, keys_written(spark, path, keys)), beside, keys, "error", file_format, rows_per_file)
    files, moved = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), []
    pattern = hadoop.Path("/".join([beside, *[f"{k}=*" for k in keys]]))
    for status in files.globStatus(pattern) or []:
        parts = status.getPath().toString().split("/")[-len(keys):]
        place = hadoop.Path("/".join([path.rstrip("/"), *parts]))
        files.mkdirs(place.getParent())
        if not files.exists(place) and files.rename(status.getPath(), place):
            moved.append(tuple(map(_value, parts)))
    files.delete(hadoop.Path(beside), True)
    return moved


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a snapshot table, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return sorted(v for v in versions if files.exists(hadoop.Path(f"{root}/version={v}/_SUCCESS")))


def snapshot_write(df: DataFrame, root: str) -> int:
    """Write a new version beside the old ones. Readers see it once it is complete, so ``df`` may read the old version.

    A version number is claimed by a file that only one writer can create; a writer that fails leaves its number unused.
    """
    spark = df.sparkSession
    hadoop, versions = spark._jvm.org.apache.hadoop.fs, snapshot_versions(spark, root)
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    version = versions[-1] + 1 if versions else 1
    while not files.createNewFile(hadoop.Path(f"{root}/_claims/{version}")):
        version += 1
    df.write.mode("error").parquet(f"{root}/version={version}")
    return version


def snapshot_read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or a given one."""
    versions = snapshot_versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no complete snapshot below {root}")
    return spark.read.parquet(f"{root}/version={version or versions[-1]}")
