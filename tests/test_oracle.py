"""Every query against its checking SQL, row by row."""

import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from workload.oracle import ORACLE
from workload.queries import QUERIES
from workload.views import TABLES


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, engine, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    cursor = engine.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.status for r in rows} >= {"FAIL", "NOT_CHECKED"}
    assert sys.modules["__spark_entry__"] is entry_module
