"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


OWN = [name for name in entry.queries() if name not in entry.TEXT_QUERIES]


def test_every_query_has_a_twin():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    found = entry.queries()[name](spark, str(FOLDER)).toPandas()
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        expected = db.execute(entry.oracle_sql()[name]).fetch_df()
    assert canonical(found) == canonical(expected)
