"""Every registered query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanloom.plans import registry

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
