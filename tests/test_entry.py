"""Every registered query against its SQL, as the driver compares them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans import catalogue, core_data, library


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted({**core_data.SQL, **library.SQL, **catalogue.SQL}))
def test_query_matches_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    df = entry.queries()[name](spark, data.replace("sf0.001", "sf0.01"))
    assert df.count() == df.distinct().count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
