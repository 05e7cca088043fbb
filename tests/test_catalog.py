"""Every query that has SQL gives DuckDB's rows, and the driver's entry point runs."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents pages events embeddings labels conversations benchmark".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(plain(r[i])) for i in order) for r in data))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    numeric = lambda data: [tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v for v in r) for r in data]
    assert rows(df.columns, numeric(map(tuple, df.collect()))) == rows(columns, numeric(want.fetchall()))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
