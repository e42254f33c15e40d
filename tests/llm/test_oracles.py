"""Queries with SQL against DuckDB on the whole small tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from trustlens.llm import queries as llm
from llm_fixtures import shipped  # noqa: F401

TABLES = "documents pages benchmark labels conversations".split()


def test_ten_queries_and_the_pipeline():
    names = set(entry.queries())
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")]
    assert "pipeline" in names and set(llm.oracle_sql()) <= set(llm.queries())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = llm.queries()[name](spark, SF_SMALL)
    cur = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    want = sorted(repr([r[columns.index(c)] for c in order]) for r in cur.fetchall())
    assert got == want
