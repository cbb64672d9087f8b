"""Rearrangements of all four kinds from SAM text: split halves, far mates, samples side by side."""

from __future__ import annotations

import pytest

from strandlake.operators import rearrangements as R
from strandlake.sources import readers


def half(name, flag, contig, start, cigar, other, mate=("c1", 100)):
    """A line of one half; other: (contig, start, strand, cigar)."""
    size = sum(int(n) for n, o in __import__("re").findall(r"(\d+)(\D)", cigar) if o in "MSI")
    tag = f"SA:Z:{other[0]},{other[1] + 1},{other[2]},{other[3]},60,0;" if other else "XX:Z:1"
    return "\t".join(map(str, [name, flag, contig, start + 1, 60, cigar, mate[0], mate[1] + 1, 0, "A" * size, "I" * size, tag]))


def split(name, first, second, turned=False, mate=None):
    """Both halves of the first read of a pair, 30 letters each, and the mate."""
    (c1, end), (c2, begin) = first, second
    start = end - 29
    strand = "-" if turned else "+"
    back = ("30M30S" if turned else "30S30M")
    far = begin - 29 if turned else begin
    lines = [half(name, 97, c1, start, "30M30S", (c2, far, strand, back)), half(name, 97 + 2048 + (16 if turned else 0), c2, far, back.replace("S", "H"), (c1, start, "+", "30M30S"))]
    if mate:
        lines.append(half(name, 145, mate[0], mate[1], "60M", None))
    return lines


@pytest.fixture
def frame(spark):
    def make(**samples):
        frames = [readers.derived(readers.sam_rows(spark.createDataFrame([(x,) for x in lines], "value string"), sample)) for sample, lines in samples.items()]
        rows = frames[0]
        for other in frames[1:]:
            rows = rows.unionByName(other)
        return rows

    return make


KINDS = {
    "DELETION": (("c1", 1000), ("c1", 5000)),
    "TANDEM_REPEAT": (("c1", 5000), ("c1", 4000)),
    "INTERCHROMOSOMAL": (("c1", 1000), ("c2", 700)),
}


@pytest.mark.parametrize("kind", [*KINDS, "INVERSION"])
def test_kinds(frame, kind):
    first, second = KINDS.get(kind, (("c1", 1000), ("c1", 3000)))
    lines = split("a", first, second, kind == "INVERSION") + split("b", (first[0], first[1] + 3), (second[0], second[1] + 2), kind == "INVERSION")
    found = R.called(frame(A=lines)).collect()
    assert [(r["kind"], r["contig"], r["place"], r["other_contig"], r["other_place"], r["n_split"], r["unique"]) for r in found] == [(kind, *first, *second, 2, True)]


def test_pairs_samples_and_members(frame):
    first, second = KINDS["DELETION"]
    pairs = [half("p", 97, "c1", 900, "60M", None, ("c1", 5100)), half("p", 145, "c1", 5100, "60M", None, ("c1", 900)), half("q", 97, "c1", 900, "60M", None, ("c1", 1000)), half("q", 145, "c1", 1000, "60M", None, ("c1", 900))]
    a = split("a", first, second, mate=("c1", 5200)) + pairs
    b = split("x", first, second) + split("y", *KINDS["TANDEM_REPEAT"])
    rows = frame(A=a, B=b)
    found = sorted((r["sample"], r["kind"], r["n_split"], r["n_pairs"], r["unique"]) for r in R.called(rows).collect())
    # the mate of the split read lies far behind the junction as well
    assert found == [("A", "DELETION", 1, 2, False), ("B", "DELETION", 1, 0, False), ("B", "TANDEM_REPEAT", 1, 0, True)]
    assert R.called(rows, least=2).count() == 0
    assert sorted((r["sample"], r["qname"], r["start"]) for r in R.members(rows).collect() if r["sample"] == "A") == [("A", "a", 971), ("A", "a", 5000), ("A", "a", 5200)]


def test_no_split_reads(frame):
    plain = frame(A=[half("q", 97, "c1", 900, "60M", None)])
    assert R.called(plain).count() == 0
    several = half("m", 97, "c1", 900, "30M30S", ("c1", 1, "+", "30S30M")).replace(",60,0;", ",60,0;c2,5,+,30S30M,60,0;")
    assert R.junctions(frame(A=[several])).count() == 0


ODD = "sample string, qname string, flag int, contig string, start int, cigar string, tags map<string,string>"


def test_odd_rows_and_repeated_halves(spark):
    """Rows that come twice, halves that disagree in strand on two contigs, and nulls."""
    sa = lambda *x: {"SA": ",".join(map(str, x)) + ",60,0;"}
    rows = [
        ("s", "far", 64, "c1", 100, "30M30S", sa("c2", 501, "+", "30S30M")),
        ("s", "far", 64, "c2", 500, "30H30M", sa("c1", 101, "-", "30M30S")),  # the strand differs, the kind does not
        ("s", "near", 64, "c1", 100, "30M30S", sa("c1", 501, "+", "30S30M")),
        ("s", "near", 64, "c1", 100, "30M30S", sa("c1", 501, "+", "30S30M")),
        ("s", "near", 80, "c1", 100, "30M30S", sa("c1", 501, "+", "30S30M")),
        ("s", "near", 128, "c1", 500, "30S30M", sa("c1", 51, "+", "30M30S")),
        (None, None, 64, "c1", 500, "30M30S", sa("c1", 101, "+", "30S30M")),
        (None, None, 64, "c1", 500, "30M30S", sa("c1", 101, "+", "30S30M")),
        ("s", "nowhere", 64, None, 500, "30M30S", sa("c1", 101, "+", "30M30S")),
        ("s", "nowhere", 64, "c1", None, "30M30S", sa("c1", 101, "+", "30S30M")),
        ("s", "flag", None, "c1", 100, "30M30S", sa("c1", 501, "+", "30S30M")),
        ("s", "cigar", 64, "c1", 100, None, sa("c1", 501, "+", "30S30M")),
        ("s", "whole", 64, "c1", 100, "60M", sa("c1", 501, "+", "30S30M")),
        ("s", "tags", 64, "c1", 100, "30M30S", None),
        ("s", "empty", 64, "c1", 100, "30M30S", {"SA": ""}),
        ("s", "other", 64, "c1", 100, "30M30S", sa("c1", 501, "+", "30M")),
        ("s", "short", 64, "c1", 100, "30M30S", {"SA": "c1,+,30S30M,60,0;"}),
        ("s", "unmapped", 68, "c1", 100, "30M30S", sa("c1", 501, "+", "30S30M")),
    ]
    found = R.junctions(spark.createDataFrame(rows, ODD).repartition(3))
    assert found.columns == ["sample", "qname", "is_first", "kind", *R.SIDES]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            ("s", "far", True, "INTERCHROMOSOMAL", "c1", 129, "c2", 500),
            ("s", "near", True, "DELETION", "c1", 129, "c1", 500),
            ("s", "near", True, "INVERSION", "c1", 129, "c1", 500),
            ("s", "near", False, "DELETION", "c1", 79, "c1", 500),
            (None, None, True, "TANDEM_REPEAT", "c1", 529, "c1", 100),
            ("s", "nowhere", True, "INVERSION", None, 529, "c1", 129),
            ("s", "nowhere", True, "INVERSION", "c1", None, "c1", 100),
        ],
        key=str,
    )


def test_names_go_without_kinds_and_numbers_first(spark):
    """Of a shuffle of names the kind is no part, since it follows from the rest; texts stand behind numbers."""
    plan = R.junctions(spark.createDataFrame([], ODD))._jdf.queryExecution().executedPlan().toString()
    (dealt,) = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    names = [c.strip().split("#")[0] for c in dealt.split("(", 1)[1].split(")")[0].split(",")][:-1]
    assert names == ["is_first", "inverted", "place", "other_place", "sample", "contig", "other_contig", "qname"]
