"""Queries of the dealt operators that SQL can express, against DuckDB on small tables."""

import os

import duckdb
import pytest

from tallyforge.llm import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    frame = registry.queries()[name](spark, FOLDER)
    answer = con.sql(registry.oracles()[name])
    columns = sorted(frame.columns)
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    want = sorted(repr([r[i] for i in places]) for r in answer.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == want
