"""Every named query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from touchline.plans import catalog, columns, endpoints, live, replayed, resolution, steps  # noqa: F401
from touchline.sources.scans import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 5)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted([[plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()], key=repr)
    assert sorted([[plain(r[c]) for c in columns] for r in got.collect()], key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
