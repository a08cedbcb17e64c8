"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["kid", "score", "title"] or e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
