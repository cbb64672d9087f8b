"""Fixtures of the text operators."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def docs(spark):
    """A function from texts (or (id, text) pairs) to a documents table."""

    def make(*rows, partitions: int = 3):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in pairs], SCHEMA).repartition(partitions)

    return make

