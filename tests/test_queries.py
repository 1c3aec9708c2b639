"""Every query with SQL against DuckDB on the smallest tables; every other one for its shape."""

import math
import os

import duckdb
import pytest

from tallyforge import queries as core

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = core.queries(), core.oracles()
SLOW = {"fit_series", "search_recipes"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(list(value)) if isinstance(value, (list, tuple)) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    answer = duck.sql(ORACLES[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in answer.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == want


def unique(rows, *keys):
    return len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


def holds_synthetic_negatives(duck, rows):
    """Boxes inside the frame, marked as background, none touching another one of its frame."""
    by = {}
    for r in rows:
        by.setdefault((r["recording"], r["frame"]), []).append(r)
    inside = all(0 <= r["left"] and r["left"] + r["width"] <= 4000 and 0 <= r["top"] and r["top"] + r["height"] <= 2200 and r["negative"] and r["source"] == "synthetic" for r in rows)
    apart = all(a["left"] + a["width"] <= b["left"] or b["left"] + b["width"] <= a["left"] or a["top"] + a["height"] <= b["top"] or b["top"] + b["height"] <= a["top"] for own in by.values() for i, a in enumerate(own) for b in own[:i])
    return rows and inside and apart


def holds_fit_series(duck, rows):
    """Each series gets each of the steps ahead once, none below zero, inside its band."""
    series = duck.sql("SELECT count(DISTINCT o_orderpriority) FROM orders").fetchall()[0][0]
    return len(rows) == 6 * series and unique(rows, "series", "step") and all(r["prediction"] >= 0 and r["lower"] <= r["upper"] for r in rows)


def holds_fit_rows(duck, rows):
    """Every open case once, with a date not before its anchor."""
    open_ = duck.sql("SELECT count(DISTINCT o_custkey) FROM orders").fetchall()[0][0]
    return len(rows) == open_ and unique(rows, "row") and all(r["prediction"] > 0 and r["predicted_date"] >= r["anchor"] for r in rows)


def holds_fit_classes(duck, rows):
    return rows and unique(rows, "row") and all(r["class"] in {"O", "F", "P"} and 0 <= r["probability"] <= 1 for r in rows)


def holds_fit_maps(duck, rows):
    """Kinds told from the very value that defines them."""
    total = duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    return sum(r["n"] for r in rows) == total and sum(r["n"] for r in rows if r["label"] == r["class"]) > 0.95 * total


def holds_search_recipes(duck, rows):
    return rows and unique(rows, "recipe") and all(r["fitness"] > 0 and r["families"] for r in rows) and min(r["fitness"] for r in rows) < 1


def holds_mc_band(duck, rows):
    """Each Monday once, with its edges in order; a draw deals out every open case."""
    open_ = duck.sql("SELECT count(DISTINCT o_custkey) FROM orders").fetchall()[0][0]
    return unique(rows, "week") and all(0 <= r["lower"] <= r["upper"] for r in rows) and sum(r["lower"] for r in rows) <= open_ <= sum(r["upper"] for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_invariants(spark, duck, name):
    """Queries that SQL can't express: what has to hold of their rows, and that a second run gives the same ones."""
    rows = [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]
    assert globals()[f"holds_{name}"](duck, rows), rows[:5]
    if name not in SLOW:
        assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in QUERIES[name](spark, FOLDER).collect())


def test_nothing_but_tables_is_read(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
