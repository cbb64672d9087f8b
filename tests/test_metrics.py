"""Transcript and capture metrics, complexity of pairs and barcode assignment against plain versions."""

from __future__ import annotations

import random

import pytest

from strandlake.operators import toolkit, transcripts

MODEL = "name string, gene string, contig string, start long, end long, negative boolean, coding_start long, coding_end long, exon_starts array<long>, exon_ends array<long>"


def models(rng):
    made = []
    for k in range(6):
        at, starts, ends = rng.randint(0, 40), [], []
        for _ in range(rng.randint(1, 4)):
            at += rng.randint(1, 9)
            starts.append(at)
            at += rng.randint(1, 12)
            ends.append(at)
        low, high = sorted(rng.sample(range(starts[0], ends[-1] + 1), 2)) if k else (starts[0], starts[0])
        made.append((f"t{k}", f"g{k}", rng.choice("cd"), starts[0], ends[-1] - 1, rng.random() < 0.5, low, high, starts, ends))
    return made


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(9)
    coverage = [(c, p, rng.randint(1, 5)) for c in "cde" for p in range(0, 110) if rng.random() < 0.7]
    return coverage, models(rng)


def frames(spark, sets):
    return spark.createDataFrame(sets[0], "contig string, pos long, value long").repartition(3), spark.createDataFrame(sets[1], MODEL)


def test_kinds_of_bases(spark, sets):
    coverage, genes = frames(spark, sets)
    ribosomal = [("c", 30, 34), ("e", 5, 5)]

    def kind(c, p):
        if any(x == c and a <= p <= z for x, a, z in ribosomal):
            return "RIBOSOMAL"
        own = [m for m in sets[1] if m[2] == c]
        inside = [m for m in own if any(a <= p < z for a, z in zip(m[8], m[9], strict=True))]
        if any(m[6] <= p < m[7] for m in inside):
            return "CODING"
        return "UTR" if inside else "INTRONIC" if any(m[3] <= p <= m[4] for m in own) else "INTERGENIC"

    expected = {}
    for c, p, v in sets[0]:
        expected[kind(c, p)] = expected.get(kind(c, p), 0) + v
    found = transcripts.locus_bases(coverage, genes, spark.createDataFrame(ribosomal, "contig string, start long, end long"))
    assert {r["kind"]: r["bases"] for r in found.collect()} == expected


def test_spliced_places_and_bias(spark, sets):
    coverage, genes = frames(spark, sets)
    at = {(c, p): v for c, p, v in sets[0]}
    spliced, biases = {}, {}
    for name, _, c, _, _, negative, _, _, starts, ends in sets[1]:
        places = [p for a, z in zip(starts, ends, strict=True) for p in range(a, z)]
        values = [at.get((c, p), 0) for p in (reversed(places) if negative else places)]
        spliced |= {(name, k): v for k, v in enumerate(values) if v}
        mean = sum(values) / len(values)
        if mean:
            end = min(4, len(values))
            sd = (sum(v * v for v in values) / len(values) - mean * mean) ** 0.5
            biases[name] = (len(values), mean, sd / mean, sum(values[:end]) / end / mean, sum(values[-end:]) / end / mean)
    assert {(r["name"], r["place"]): r["value"] for r in transcripts.spliced_coverage(coverage, genes).collect()} == spliced
    rows = transcripts.end_bias(coverage, genes, 4)
    found = {r["name"]: (r["length"], r["mean"], r["cv"], r["five_prime"], r["three_prime"]) for r in rows.collect()}
    assert found.keys() == biases.keys()
    assert all(found[n] == pytest.approx(biases[n], abs=1e-5) for n in found)
    summary = transcripts.bias_summary(rows, 3).first()
    assert summary["transcripts"] == 3


def test_capture(spark, sets):
    coverage, _ = frames(spark, sets)
    baits = [("b1", "c", 10, 30), ("b2", "c", 60, 61), ("b3", "e", 0, 3)]
    frame = spark.createDataFrame(baits, "name string, contig string, start long, end long")
    expected = {}
    for c, p, v in sets[0]:
        own = [(a, z) for _, x, a, z in baits if x == c]
        kind = "ON" if any(a <= p <= z for a, z in own) else "NEAR" if any(a - 7 <= p <= z + 7 for a, z in own) else "OFF"
        expected[kind] = expected.get(kind, 0) + v
    assert {r["kind"]: r["bases"] for r in toolkit.capture_bases(coverage, frame, 7).collect()} == expected
    at = {(c, p): v for c, p, v in sets[0]}
    depths = sorted(at.get((c, p), 0) for _, c, a, z in baits for p in range(a, z + 1))
    mean, p20 = sum(depths) / len(depths), depths[len(depths) // 5]
    row = toolkit.evenness(coverage, frame).first()
    assert (row["bases"], row["p20"]) == (len(depths), p20) and row["mean"] == pytest.approx(mean, abs=1e-5)
    assert row["fold_80"] == (pytest.approx(mean / p20, abs=1e-5) if p20 else None)
    none = toolkit.evenness(coverage.limit(0), frame).first()
    assert (none["mean"], none["p20"], none["fold_80"]) == (0.0, 0, None)


def test_pair_complexity(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("AC", k=7)), "".join(rng.choices("AC", k=8))) for _ in range(300)] + [("AC", "ACACACA")]
    counts = {}
    for a, b in pairs:
        if len(a) >= 6 and len(b) >= 6:
            counts[a[:6] + b[:6]] = counts.get(a[:6] + b[:6], 0) + 1
    kept, sizes = [], {}
    for x in sorted(counts, key=lambda x: (-counts[x], x)):
        into = next((k for k in kept if k[:2] + k[6:8] == x[:2] + x[6:8] and sum(p != q for p, q in zip(k, x, strict=True)) <= 2), x)
        if into is x:
            kept.append(x)
        sizes[into] = sizes.get(into, 0) + counts[x]
    found = toolkit.pair_complexity(spark.createDataFrame(pairs, "first string, second string"), 6, identical=2, rate=0.17)
    assert {r["leader"]: r["n"] for r in found.collect()} == sizes


def test_barcodes_need_a_clear_best(spark):
    rng = random.Random(6)
    sheet = [(f"s{k}", "".join(rng.choices("ACGT", k=8))) for k in range(12)] + [("twin1", "AAAAAAAA"), ("twin2", "AAAAAAAT")]
    codes = [list(rng.choice(sheet)[1]) for _ in range(300)]
    for c in codes:
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(8)] = rng.choice("ACGTN")
    codes = ["".join(c) for c in codes]
    differ = lambda a, b: sum(x != y and x != "N" for x, y in zip(a, b, strict=True))

    def plain(code, mismatches, margin):
        ranked = sorted((differ(code, own), s) for s, own in sheet)
        clear = code.count("N") <= 2 and ranked[0][0] <= mismatches and ranked[1][0] - ranked[0][0] >= margin
        return ranked[0][1] if clear else None

    reads = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    for mismatches, margin in ((1, 1), (2, 2), (0, 1)):
        found = toolkit.assigned_barcodes(reads, spark.createDataFrame(sheet, "sample string, code string"), 8, mismatches, margin)
        assert {r["id"]: r["sample"] for r in found.collect()} == {k: plain(c, mismatches, margin) for k, c in enumerate(codes)}


def test_insert_metrics_of_sums_whose_squares_outgrow_a_long(spark):
    rows = spark.range(40).selectExpr("'FR' AS orientation", "CAST(100000000 + id % 2 AS INT) AS insert_size")
    got = toolkit.insert_metrics(rows).first()
    assert (got["n"], got["median"], got["mean"], got["sd"]) == (40, 100000000.5, 100000000.5, round((40 * 0.25 / 39) ** 0.5, 6))
