"""Every registered query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from strandlake.plans import catalog
from strandlake.standins import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in found.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_interval_joins_are_no_nested_loops(spark, capsys):
    catalog.QUERIES["J06_overlapping_features"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_needed_columns_only(spark, capsys):
    catalog.QUERIES["J09_samples_at_position"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
