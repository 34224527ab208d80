"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

from pathloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, db, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(map(plain, r))) for r in frame.select(*columns).collect())
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_entry_works_without_extensions():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
