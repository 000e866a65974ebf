"""Helpers for the operators that run Python inside Spark's tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


def pieces(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch, so that the Python objects of few texts exist at a time. A slice copies nothing."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers that share this machine's folders import the package from where the driver did.

    On a cluster the package comes with ``--py-files`` or is installed; the extra path then does no harm.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., list]], rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Rows made from the named columns inside the tasks that read them: no shuffle, a slice of an Arrow batch at a time.

    ``make`` is called once in a task and returns a function from the columns' value lists to one list for each column
    of ``schema``. Only the named columns leave the JVM; they may be names or ``Column``s with an alias.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    workers_find_package(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, rows):
                found = work(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, field.type) for x, field in zip(found, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], list | None], salt: str = "group") -> DataFrame:
    """Rows made from each group of rows with equal keys. Groups must be small; a task holds a batch and one group.

    The rows are brought together by their keys and sorted, and a task cuts its stream of batches where the keys change: a
    great many groups of a few rows cost no more than their rows. ``work`` gets a group's other columns and returns one list
    for each column of ``schema``, or nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    workers_find_package(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    named = df.select(F.concat_ws("|", *keys).alias(salt), *[c for c in df.columns if c not in keys])
    named = named.repartition(salt).sortWithinPartitions(salt)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def done(whole: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            found = [x for a, b in zip(cuts, cuts[1:]) if b > a and (x := work(whole.slice(a, b - a)))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v for x in found for v in x[i]], field.type) for i, field in enumerate(arrow)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            whole = (pa.concat_tables([kept, table]) if kept is not None else table).combine_chunks()
            names = whole.column(salt)
            changes = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy().nonzero()[0] + 1
            rest = whole.drop_columns([salt])
            if len(changes):
                yield from done(rest, [0, *changes.tolist()])
            kept = whole.slice(int(changes[-1]) if len(changes) else 0)
        if kept is not None:
            yield from done(kept.drop_columns([salt]), [0, kept.num_rows])

    return named.mapInArrow(run, schema)


def list_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    column = table.column(name).combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_or_empty(name: str = "text"):
    """Column with nulls read as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)

