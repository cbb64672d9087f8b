"""Numbering a total order in range partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake import session
from strandlake.operators.order import numbered, numbered_within, ranged, stretches, summed_before
from strandlake.streaming import windows


@pytest.mark.parametrize(("n", "partitions"), [(0, 3), (1, 3), (500, 7)])
def test_places_are_those_of_a_sort(spark, n, partitions):
    rng = random.Random(n)
    values = [(rng.randint(0, 40), k) for k in range(n)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(partitions)
    found = {(r["a"], r["b"]): r["place"] for r in numbered(rows, [F.desc("a"), "b"]).collect()}
    assert found == {v: k for k, v in enumerate(sorted(values, key=lambda v: (-v[0], v[1])), 1)}


def test_no_plan_has_all_rows_in_one_task(spark, capsys):
    numbered(spark.range(1000).withColumn("x", F.col("id") % 7), ["x", "id"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan or "__n" in plan


def test_rows_out_of_order_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "user int, sequence int, ts int")
    with pytest.raises(PySparkException):
        windows.ordered_or_error(rows, ["user"], "ts").collect()


@pytest.mark.parametrize("partitions", [1, 6])
def test_places_within_groups_and_sums_before(spark, partitions):
    """A hot group, equal rows and groups of one row."""
    rng = random.Random(partitions)
    values = [("hot" if k % 3 else f"g{rng.randint(0, 9)}", rng.randint(0, 30), rng.randint(0, 5)) for k in range(900)]
    rows = spark.createDataFrame(values, "g string, a int, v int").repartition(partitions)
    by_group = {}
    for g, a, v in sorted(values, key=lambda r: (r[1], r[2])):
        by_group.setdefault(g, []).append((a, v))
    found = numbered_within(rows, "g", ["a", "v"]).collect()
    assert sorted((r["g"], r["place"], r["a"], r["v"]) for r in found) == sorted((g, k, a, v) for g, own in by_group.items() for k, (a, v) in enumerate(own))
    assert {(r["g"], r["size"]) for r in found} == {(g, len(own)) for g, own in by_group.items()}
    held = ranged(rows, "g", ["a", "v"])
    parts = stretches(held, "g", F.col("v"))
    sums = held.withColumn("own", summed_before(held, "g", ["a", "v"], F.col("v"))).join(parts, ["__part", "g"]).selectExpr("g", "a", "v", "own + __before AS before", "__all")
    expected = [(g, a, v, sum(x[1] for x in own[:k]), sum(x[1] for x in own)) for g, own in by_group.items() for k, (a, v) in enumerate(own)]
    assert sorted(map(tuple, sums.collect())) == sorted(expected)
    assert numbered_within(rows.limit(0), "g", ["a"]).count() == 0


def test_numbers_with_a_cut_in_packs(spark, monkeypatch):
    """Kept columns of all kinds, over many packs, have the places that all columns have."""
    monkeypatch.setattr(session, "PACK_ROWS", 70)
    rows = spark.range(3000).selectExpr("id * 7919 % 3001 AS a", "id % 5 AS b", "IF(id % 3 = 0, NULL, concat('t', id)) AS text", "named_struct('x', id, 'y', array(id % 4, NULL)) AS s").repartition(7)
    expected = sorted(map(tuple, numbered(rows, ["a", "b"]).select("text", "s", "place").collect()), key=lambda r: r[2])
    got = numbered(rows, ["a", "b"], keep=["text", "s"])
    assert got.columns == ["text", "s", "place"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == expected
