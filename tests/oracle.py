"""Compare a query's rows with those of its SQL in DuckDB, exactly."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def compare(df, sql: str, db: duckdb.DuckDBPyConnection) -> list[str]:
    """Differences found; empty when the two agree."""
    expected = db.sql(sql)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    names = sorted(df.columns)
    if names != sorted(expected.columns):
        return [f"columns: spark {names} sql {sorted(expected.columns)}"]
    problems = [f"type of {n}: spark {t} sql {kinds[n]}" for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]]
    mine = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    order = [expected.columns.index(n) for n in names]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in expected.fetchall())
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        problems.append(
            f"rows: spark {sum(mine.values())} sql {sum(theirs.values())}, only spark {sum(extra.values())} "
            f"{list(extra)[:2]}, only sql {sum(missing.values())} {list(missing)[:2]}")
    return problems
