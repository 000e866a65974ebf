"""Scans. Schemas are declared; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def read_table_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, index_column: bool = False, separator: str = ",",
    null_text: str = "NA", glob: str | None = None, multi_line: bool = True, header: bool = True,
) -> DataFrame:
    """CSV with a header; ``NA`` is null; quotes are doubled inside quoted text.

    ``index_column`` skips the unnamed first column that data-frame exports carry. ``multi_line`` allows line breaks
    inside quotes but makes a file one task: switch it off for large files without them.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if index_column:
        fields = T.StructType([T.StructField("__index", T.StringType()), *fields.fields])
    reader = spark.read.schema(fields).option("header", header).option("sep", separator).option("nullValue", null_text) \
        .option("multiLine", multi_line).option("escape", '"').option("enforceSchema", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.csv(path if isinstance(path, str) else list(path)).drop("__index")


def read_ragged(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, glob: str | None = None, header: bool = True,
) -> DataFrame:
    """Comma text whose short rows are filled up with null. Files are split over tasks."""
    return read_table_csv(spark, path, schema, glob=glob, multi_line=False, header=header)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small lookup table written in code. It is part of the plan, with a known size, so joins can broadcast it."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = [pa.array([row[i] for row in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields.fields)]
    return spark.createDataFrame(pa.table(columns, names=fields.names), fields)


def read_many(
    spark: SparkSession, folder: str | Sequence[str], schema: T.StructType | str, glob: str = "*.csv", index_column: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """All matching files below one or more folders as one table, in one scan."""
    return read_table_csv(spark, folder, schema, index_column=index_column, glob=glob, multi_line=multi_line)


def with_path_year(df: DataFrame, name: str = "year") -> DataFrame:
    """The year in the name of the file's folder (``Cube March 2023`` -> 2023): its first run of just four digits.

    A folder without one stops the job.
    """
    folder = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -2)
    year = F.regexp_extract(folder, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
    return df.select("*", F.coalesce(year, F.raise_error(F.concat(F.lit("no year in the folder name "), folder)).cast("int")).alias(name))


def pick_files(df: DataFrame, prefer: dict[int, str], year: str = "year") -> DataFrame:
    """Where a year's folder holds several matching files, keep the named one: ``{2024: "FACTDATA_MAR2024.TXT"}``."""
    keep = F.lit(True)
    for when, file_name in prefer.items():
        keep = F.when(F.col(year) == when, F.col("_metadata.file_name") == file_name).otherwise(keep)
    return df.filter(keep)


def year_range(df: DataFrame, year: str = "year") -> DataFrame:
    """One row: first and last year."""
    return df.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"))


def read_json_pages(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, items: str, keep: Sequence[str] = (),
    page_in_path: str | None = r".*page=?(\d+)", multi_line: bool = True,
) -> DataFrame:
    """Landed result pages -> one row per record of the array at the dotted path ``items``.

    The page number comes from the file's path, or from a page's own columns named in ``keep``. ``multi_line=False`` reads
    one page per line. Use ``flatten_struct`` for the nested fields; arrays stay arrays.
    """
    pages = spark.read.schema(schema).option("multiLine", multi_line).json(path if isinstance(path, str) else list(path))
    tags = [F.col(c) for c in keep]
    if page_in_path:
        tags.append(F.regexp_extract(F.col("_metadata.file_path"), page_in_path, 1).try_cast("int").alias("page"))
    return pages.select(F.explode(items).alias("__item"), *tags).select("__item.*", *[c for c in (*keep, "page" if page_in_path else None) if c])
