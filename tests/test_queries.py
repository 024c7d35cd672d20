"""Every registered telemetry query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom.queries import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.SQL)


def values(rows):
    return sorted(tuple("" if v is None else (repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert values(got.select(*columns).collect()) == values(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
