"""Reference letters: queries against their SQL on larger tables, and places beyond the known letters."""

from __future__ import annotations

import duckdb
import pytest

from strandlake.operators import pileup, toolkit
from strandlake.plans import catalog
from strandlake.standins import TABLES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["J03_reference_bases", "V19_extracted_sequences"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, FOLDER)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted(result.fetchall())
    assert sorted(tuple(r) for r in found.select(*names).collect()) == theirs


def test_places_beyond_the_reference_stay(spark):
    chunks = pileup.reference_chunks(spark.createDataFrame([("c", "ACGTACG")], "contig string, seq string"), 4)
    places = spark.createDataFrame([("c", 0), ("c", 6), ("c", 7), ("c", 8), ("c", 40)], "contig string, pos int")
    found = {r["pos"]: r["wt"] for r in pileup.with_reference(places, chunks, 4).collect()}
    assert found == {0: "A", 6: "G", 7: "", 8: "", 40: ""}
    parts = spark.createDataFrame([("x", "c", 1, 2), ("y", "c", 5, 12), ("z", "c", 9, 11)], "name string, contig string, start int, end int")
    cut_out = {r["name"]: r["seq"] for r in toolkit.extract_sequences(parts, chunks, 4).collect()}
    assert cut_out == {"x": "CG", "y": "CG", "z": ""}
