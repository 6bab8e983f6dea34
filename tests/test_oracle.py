"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

import __spark_entry__ as work  # noqa: E402
from check import TABLES, normalise  # noqa: E402
from crossweave.plans.workload import registered  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registered()) <= set(work.oracle_sql()) <= set(work.queries())


@pytest.mark.parametrize("name", sorted(work.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    ours = normalise(work.queries()[name](spark, SMALL).toPandas())
    theirs = normalise(db.execute(work.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    same = (ours == theirs) | (ours.isna() & theirs.isna())
    assert same.all(axis=None)


def test_entry(spark):
    assert work.entry(spark).columns == ["query_id", "from", "from_title", "to", "to_title", "lang"]
