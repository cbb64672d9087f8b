"""Packed position arrays: integers, rows and files, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.sources import arrays


def plain_pack(values):
    out = bytearray()
    for v in values:
        v &= (1 << 64) - 1
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1)))
def test_integers(values):
    data = arrays.pack(np.array(values, np.int64))
    assert data == plain_pack(values)
    back, rest = arrays.unpack(data)
    assert back.tolist() == values and rest == b""
    half, rest = arrays.unpack(data[:-1])
    assert plain_pack(half.tolist()) + rest == data[:-1]


def dense(rows, lengths):
    made = {c: [0] * n for c, n in lengths.items()}
    for c, p, v in rows:
        made[c][p] += v
    return sorted((c, k, v) for c, own in made.items() for k, v in enumerate(own))


@pytest.fixture(scope="module")
def values():
    rng = random.Random(8)
    return [(rng.choice("ab"), rng.randrange(3000), rng.choice([1, 5, 200, 70_000, -3])) for _ in range(900)] + [("c", 5000, 9), ("d", 0, 1)]


SCHEMA = "contig string, pos long, value long"


def test_rows_round_trip(spark, values):
    chunks = arrays.packed(spark.createDataFrame(values, SCHEMA), chunk=256)
    lengths = {c: max(p for k, p, _ in values if k == c) + 1 for c in "abcd"}
    assert sorted(map(tuple, arrays.unpacked(chunks, 256).collect())) == dense(values, lengths)
    assert {(r["contig"], r["chunk"], r["size"]) for r in chunks.collect()} == {(c, k, min(256, n - 256 * k)) for c, n in lengths.items() for k in range(-(-n // 256))}
    assert arrays.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_lengths(spark):
    contigs = spark.createDataFrame([("a", 600), ("b", 3)], "contig string, length long")
    rows = arrays.unpacked(arrays.packed(spark.createDataFrame([("a", 5, 2)], SCHEMA), contigs, chunk=256), 256)
    assert sorted(map(tuple, rows.collect())) == dense([("a", 5, 2)], {"a": 600, "b": 3})
    with pytest.raises(Exception, match="beyond"):
        arrays.packed(spark.createDataFrame([("b", 3, 2)], SCHEMA), contigs).collect()


def plain_message(sample, contigs):
    text = lambda k, b: plain_pack([k << 3 | 2, len(b)]) + b
    return text(1, sample) + text(2, b"v") + text(3, b"") + b"".join(text(4, text(1, c) + text(2, plain_pack(v))) for c, v in contigs)


@pytest.mark.parametrize("segment", [256, None])
def test_files_round_trip(spark, values, tmp_path, segment):
    path = str(tmp_path / "n")
    arrays.write(arrays.packed(spark.createDataFrame(values, SCHEMA), chunk=256), path, "s1")
    found = arrays.read(spark, path, segment, split=300)
    lengths = {c: max(p for k, p, _ in values if k == c) + 1 for c in "abcd"}
    assert sorted((r["contig"], r["pos"], r["value"]) for r in found.collect()) == dense(values, lengths)
    assert {r["sample"] for r in found.select("sample").distinct().collect()} == {"s1"}
    assert (found.rdd.getNumPartitions() > 4) == (segment is not None)
    assert sorted(p.suffix for p in (tmp_path / "n").iterdir()) == [".numbers"] * 4


def test_files_of_others_and_joined_files(spark, tmp_path):
    (tmp_path / "x").write_bytes(plain_message(b"s", [(b"a", [1, 300, -2]), (b"b", [])]) + plain_message(b"t", [(b"a", [7])]))
    assert sorted(map(tuple, arrays.read(spark, str(tmp_path / "x"), None).collect())) == [("s", "a", 0, 1), ("s", "a", 1, 300), ("s", "a", 2, -2), ("t", "a", 0, 7)]
    (tmp_path / "y").write_bytes(plain_message(b"s", [(b"a", [1]), (b"a", [2])]))
    with pytest.raises(Exception, match="twice"):
        arrays.read(spark, str(tmp_path / "y"), None).collect()
    arrays.write(arrays.packed(spark.createDataFrame([("a", 600, 1)], SCHEMA), chunk=256), str(tmp_path / "z"))
    with pytest.raises(Exception, match="segment"):
        arrays.read(spark, str(tmp_path / "z"), 100).collect()
