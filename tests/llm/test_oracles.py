"""Registered queries with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from strandlake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL | queries.REPORT_SQL))
def test_query_equals_sql(spark, duck, name):
    found = (queries.QUERIES | queries.REPORTS)[name](spark, FOLDER)
    columns = sorted(found.columns)
    ours = sorted(str([row[c] for c in columns]) for row in found.collect())
    result = duck.execute((queries.ORACLE_SQL | queries.REPORT_SQL)[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == sorted(str([row[names.index(c)] for c in columns]) for row in result.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
