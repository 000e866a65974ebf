"""Yearly files whose headers differ: each file is read in its own column order and the files are stacked by name."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicgauge.operators.combine import union_by_name

READERS_AT_ONCE = 16


def list_files(spark: SparkSession, folder: str | Sequence[str], glob: str = "*", years: Iterable[int] | None = None, prefer: Mapping[int, str] | None = None) -> list[str]:
    """Paths of the matching files below one or more folders, as Spark lists them; nothing is read.

    ``years`` keeps the files of these years' folders only (see ``folder_year``). Where a year in ``prefer`` has several
    matching files, or folders of files, the named one is kept. So files of other years are not in the scan at all.
    """
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder if isinstance(folder, str) else list(folder)).inputFiles()
    paths = sorted(unquote(p) for p in found)
    if years is not None:
        asked = set(years)
        paths = [p for p in paths if folder_year(p) in asked]
    for year, name in (prefer or {}).items():
        paths = [p for p in paths if folder_year(p) != year or name in p.rsplit("/", 2)[-2:]]
    return paths


def folder_year(path: str) -> int | None:
    """The first run of just four digits in the name of a file's folder, or of the next one above that has such a run."""
    for folder in reversed(path.split("/")[:-1]):
        if found := re.search(r"(?<!\d)\d{4}(?!\d)", folder):
            return int(found.group())
    return None


def as_pattern(path: str) -> str:
    """A path that Spark takes as it is, though it holds characters of a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_header(spark: SparkSession, path: str, separator: str = ",") -> tuple[str, ...]:
    """Names in the first row of a file, which may be compressed or hold line breaks in quotes. None for an empty file."""
    java, hadoop = spark._jvm.java.io, spark._jvm.org.apache.hadoop
    conf, file = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        lines = java.BufferedReader(java.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        text = lines.readLine()
        while text is not None and text.count('"') % 2 and (more := lines.readLine()) is not None:
            text += "\n" + more
    finally:
        stream.close()
    return tuple(next(csv.reader([text.lstrip("﻿")], delimiter=separator), ())) if text else ()


def read_headers(spark: SparkSession, paths: Sequence[str], separator: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by their headers. The first lines are read by the driver, which also lists the files; data stays where it is."""
    with ThreadPoolExecutor(READERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda p: read_header(spark, p, separator), paths))
    found: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(paths, headers):
        if header:
            found.setdefault(header, []).append(path)
    return found


def by_year(files: Sequence[str], named: bool) -> list[tuple[int | None, list[str]]]:
    """Files by the years of their folders, if these are asked for. A folder without a year stops the job."""
    found: dict[int | None, list[str]] = {}
    for path in files:
        year = folder_year(path) if named else None
        if named and year is None:
            raise ValueError(f"no year in the folders of {path}")
        found.setdefault(year, []).append(path)
    return sorted(found.items())


def plain_name(name: str) -> str:
    """How names are compared: small letters and digits, everything between them one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def match_header(header: Sequence[str], names: Sequence[str], aliases: Mapping[str, str], index_column: bool, unknown: str) -> list[str | None]:
    """The wanted name of each column of a file, null for one that is left out."""
    wanted = {plain_name(n): n for n in names} | {plain_name(a): n for a, n in aliases.items()}
    found: list[str | None] = []
    for i, column in enumerate(header):
        name = wanted.get(plain_name(column))
        unnamed_index = index_column and i == 0 and not column.strip()
        if name is None and not unnamed_index and unknown == "error":
            raise ValueError(f"column {column!r} is not in the schema")
        found.append(name)
    twice = sorted({n for n in found if n and found.count(n) > 1})
    if twice:
        raise ValueError(f"columns {twice} are there twice in {list(header)}")
    return found


def read_by_header(
    spark: SparkSession, folder: str | Sequence[str], schema: T.StructType | str, glob: str = "*.csv", aliases: Mapping[str, str] | None = None,
    required: Iterable[str] = (), unknown: str = "error", index_column: bool = False, separator: str = ",", null_text: str = "NA",
    multi_line: bool = False, year: str | None = None, years: Iterable[int] | None = None, prefer: Mapping[int, str] | None = None,
) -> DataFrame:
    """All matching files below the folders as one table with the columns of ``schema``, whatever the order in each file.

    Files with the same header (and year) are one scan, with types by name; the scans are stacked by name. A column a file lacks is
    null there, unless it is ``required``; a column that the schema does not know stops the job, or is left out with
    ``unknown="drop"``. Names match without regard to case and signs; ``aliases`` maps other names in files to names of the
    schema. Spark compares each file's header with that of its scan once more while reading. ``year`` names a column for the
    year in the folder's name; ``years`` and ``prefer`` choose files before anything is read (see ``list_files``).
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = {f.name: f.dataType for f in fields.fields}
    paths = list_files(spark, folder, glob, years, prefer)
    scans = []
    for header, files in sorted(read_headers(spark, paths, separator).items()):
        names = match_header(header, fields.names, aliases or {}, index_column, unknown)
        lacking = [c for c in required if c not in names]
        if lacking:
            raise ValueError(f"{files[0]} lacks {lacking}")
        # Without a name of its own for each column the header cannot be compared again.
        distinct = all(header) and len({h.lower() for h in header}) == len(header)
        own = T.StructType([T.StructField(h if distinct else f"__{i}", kinds.get(n, T.StringType())) for i, (h, n) in enumerate(zip(header, names))])
        reader = spark.read.schema(own).option("header", True).option("sep", separator).option("nullValue", null_text) \
            .option("multiLine", multi_line).option("escape", '"').option("enforceSchema", not distinct)
        columns = [(F.col(f"__{names.index(n)}") if n in names else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()]
        for when, group in by_year(files, year is not None):
            rows = reader.csv(list(map(as_pattern, group))).toDF(*[f"__{i}" for i in range(len(header))])
            scans.append(rows.select(*columns, *([F.lit(when).alias(year)] if year else [])))
    if not scans:
        return spark.createDataFrame([], T.StructType([*fields.fields, *([T.StructField(year, T.IntegerType())] if year else [])]))
    return reduce(union_by_name, scans)
