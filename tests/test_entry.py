"""The registry, and every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quire.jobs import more_queries, package_queries, queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, (bool, str)):
        return str(value)
    try:
        return repr(round(float(value), 5) + 0.0)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    place = [want.columns.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_all_merges_are_expanded(spark):
    from quire.jobs.queries import _merges

    assert queries.QUERIES["c7_expand_merges"](spark, DIR).count() == _merges(spark, DIR).count()
