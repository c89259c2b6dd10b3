"""Every query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from furrow import queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    cursor = tables.execute(queries.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    order = [theirs.index(c) for c in names]
    key = lambda row: [(x is None, str(x)) for x in row]
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert rows and rows == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=key)


def test_the_rest_stands_without_the_text_operators():
    """No other module imports the subpackage."""
    root = os.path.dirname(queries.__file__)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "furrow.llm" not in open(path, encoding="utf-8").read(), path
