"""Every registered query against its SQL twin."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(table, columns):
    return sorted(tuple(map(repr, r)) for r in zip(*[table.column(c).to_pylist() for c in columns]))


def arrow(result):
    return result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toArrow(), arrow(db.execute(ORACLES[name]))
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
