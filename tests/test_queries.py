"""Every registered query against its SQL on the smallest given tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry
from queries.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], db) == []


@needs_data
def test_entry_runs(spark):
    assert entry(spark).count() > 0
