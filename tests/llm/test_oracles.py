"""Registered queries with SQL against DuckDB."""

import os

import duckdb
import pytest

from spanloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(FOLDER):
        duck.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(found, key=str)
