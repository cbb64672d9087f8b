"""Interval joins and algebra against loops, with stretches much shorter than contigs."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake.operators import intervals as I


@pytest.fixture
def sets(spark):
    rng = random.Random(9)
    make = lambda n: [(c, s := rng.randint(0, 300), s + rng.choice([0, 3, 40, 90])) for c in "xy" for _ in range(n)]
    a, b = make(12), make(9)
    frame = lambda rows: spark.createDataFrame(rows, "contig string, start long, end long")
    return a, b, frame(a), frame(b)


def covered(rows):
    return {(c, p) for c, s, e in rows for p in range(s, e + 1)}


def found(df):
    rows = [(r["contig"], r["start"], r["end"]) for r in df.collect()]
    places = [(c, p) for c, s, e in rows for p in range(s, e + 1)]
    assert len(places) == len(set(places))
    assert not any((c, e + 1) in set(places) or (c, s - 1) in set(places) for c, s, e in rows)
    return set(places)


@pytest.mark.parametrize("stretch", [16, 1 << 16])
def test_algebra(spark, sets, monkeypatch, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    monkeypatch.setattr(I.running, "__defaults__", (stretch,))
    a, b, x, y = sets
    assert found(I.merge(x)) == covered(a)
    assert found(I.intersect(x, y)) == covered(a) & covered(b)
    assert found(I.subtract(x, y)) == covered(a) - covered(b)
    assert found(I.symmetric_difference(x, y)) == covered(a) ^ covered(b)
    contigs = spark.createDataFrame([("x", 500), ("y", 450)], "contig string, length long")
    assert found(I.invert(x, contigs)) == ({("x", p) for p in range(500)} | {("y", p) for p in range(450)}) - covered(a)


@pytest.mark.parametrize("stretch", [5, 1 << 16])
def test_threshold_runs(spark, monkeypatch, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    rng = random.Random(10)
    values = [(c, p, rng.randint(0, 9)) for c in "xy" for p in range(120) if rng.random() < 0.9]
    got = {(r["contig"], r["start"], r["end"], r["last_value"]) for r in I.threshold_runs(spark.createDataFrame(values, "contig string, pos long, value int"), 3).collect()}
    expected, high = set(), {(c, p): v for c, p, v in values if v >= 3}
    for c, p in high:
        if (c, p - 1) not in high:
            e = p
            while (c, e + 1) in high:
                e += 1
            expected.add((c, p, e, high[c, e]))
    assert got == expected


def test_joins_with_long_and_short_intervals(spark):
    rng = random.Random(11)
    rows = [(f"n{k}", rng.choice("xy"), s := rng.randint(0, 50_000), s + rng.choice([0, 5, 63, 64, 1000, 40_000])) for k in range(60)]
    places = [(rng.choice("xyz"), rng.randint(0, 60_000)) for _ in range(300)] + [(c, s) for _, c, s, _ in rows] + [(c, e) for _, c, _, e in rows] + [(c, e + 1) for _, c, _, e in rows]
    f = spark.createDataFrame(rows, "name string, contig string, start long, end long")
    p = spark.createDataFrame(places, "contig string, pos long")
    got = sorted((r["contig"], r["pos"], r["name"]) for r in I.overlapping(p, f).collect())
    assert got == sorted((c, q, n) for c, q in places for n, d, s, e in rows if c == d and s <= q <= e)
    hit = sorted((r["contig"], r["pos"]) for r in I.inside(p, f).collect())
    assert hit == sorted((c, q) for c, q in places if any(c == d and s <= q <= e for _, d, s, e in rows))
    assert I.outside(p, f).count() + len(hit) == len(places)


def test_single_feature_fails_on_two(spark):
    f = spark.createDataFrame([("a", "x", 0, 9), ("b", "x", 5, 9)], "name string, contig string, start long, end long")
    p = spark.createDataFrame([("x", 2)], "contig string, pos long")
    assert I.single_feature(p, f).first()["name"] == "a"
    with pytest.raises(PySparkException):
        I.single_feature(p.withColumn("pos", F.lit(6)), f).collect()


def test_arrays_of_other_lengths_fail(spark):
    p = spark.createDataFrame([("x", 0, 1), ("x", 1, 1)], "contig string, pos long, value long")
    assert [r["value"] for r in I.sum_arrays([p, p]).orderBy("pos").collect()] == [2, 2]
    with pytest.raises(PySparkException):
        I.sum_arrays([p, p.where("pos = 0")]).collect()


def test_moving_average(spark):
    rows = [("x", k, float(k % 7)) for k in range(50)]
    got = {r["pos"]: r["ema"] for r in I.moving_average(spark.createDataFrame(rows, "contig string, pos long, value double"), 0.2, 4).collect()}
    average, expected = 0.0, {}
    for _, k, v in rows:
        average = 0.2 * v + 0.8 * average
        if k % 5 == 4:
            expected[k] = average
    assert got == pytest.approx(expected)


def test_overlaps_broadcast_neither_side_and_look_into_levels_that_exist(spark, capsys):
    rows = spark.range(500).selectExpr("concat('f', id) AS name", "'c' AS contig", "id AS start", "id + 20 AS end")
    joined = I.overlapping(rows.selectExpr("contig", "start AS pos"), rows)
    joined.explain("formatted")
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and "NestedLoop" not in plan
    assert joined.count() == sum(min(k, 20) + 1 for k in range(500))
    assert I._probes(rows.selectExpr("contig", "start AS pos"), "pos", [0]).count() == 500
    wide = spark.createDataFrame([("c", 0, 10**6), ("c", 5, 9), ("c", 10**5, 2 * 10**5)], "contig string, start long, end long")
    assert I.overlapping(rows.selectExpr("contig", "start AS pos"), wide).count() == 505
    assert I.overlapping(rows.selectExpr("contig", "start AS pos"), wide.where("start < 0")).count() == 0
