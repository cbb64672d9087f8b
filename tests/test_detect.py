"""From SAM text to calls: small cases on both strands, two contigs and changes of all kinds."""

from __future__ import annotations

import random
import re

import pytest

from strandlake.operators import detect as D
from strandlake.operators import pileup
from strandlake.params import Params
from strandlake.sources import readers

RNG = random.Random(11)
CONTIGS = {c: "".join(RNG.choices("ACGT", k=500)) for c in ("chr1", "chr2")}
PARAMS = Params(minNumberDuplexesSisterSamples=1)
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}


def complement_code(code: str) -> str:
    return code + "TCT"


def reads_of(contig, start, end, n_top, n_bottom, change=None, codes=("AAA", "CCC"), name="m", mutated=None, top_only=False, length=70):
    """SAM lines of one molecule. change: (kind, pos); mutated: top reads that have it, all if None."""
    seq = CONTIGS[contig]
    lines = []
    for strand, n in (("F", n_top), ("O", n_bottom)):
        for k in range(n):
            has = change is not None and not (strand == "O" and top_only) and (mutated is None or strand == "O" or k < mutated)
            bc = codes if strand == "F" else codes[::-1]
            qname = f"I:1:F:1:1101:{start}:{k}{strand}{name}{contig}_BC:Z:{complement_code(bc[0])}_BC:Z:{complement_code(bc[1])}_"
            for left in (True, False):
                at = start if left else end - length + 1
                letters, cigar = seq[at : at + length], f"{length}M"
                if has and at < change[1] < at + length - 1:
                    kind, pos = change
                    i = pos - at
                    if kind == "SUB":
                        letters = letters[:i] + OTHER[letters[i]] + letters[i + 1 :]
                    elif kind == "INS":
                        letters, cigar = letters[: i + 1] + "GG" + letters[i + 1 :], f"{i + 1}M2I{length - i - 1}M"
                    else:
                        letters, cigar = letters[:i] + letters[i + 2 :], f"{i}M2D{length - i - 2}M"
                first = left == (strand == "F")
                flag = 1 | (64 if first else 128) | (0 if left else 16) | (32 if left else 0)
                mate = end - length + 1 if left else start
                lines.append("\t".join(map(str, [qname, flag, contig, at + 1, 60, cigar, "=", mate + 1, (1 if left else -1) * (end - start + 1), letters, "I" * len(letters)])))
    return lines


@pytest.fixture
def run(spark):
    def go(samples, params=PARAMS, partitions=2):
        frames = [readers.sam_rows(spark.createDataFrame([(line,) for line in lines], "value string").repartition(partitions), sample) for sample, lines in samples.items()]
        rows = frames[0]
        for other in frames[1:]:
            rows = rows.unionByName(other)
        reference = pileup.reference_chunks(spark.createDataFrame(list(CONTIGS.items()), "contig string, seq string"), 100, 50)
        return D.detect(readers.derived(rows), reference, params, 100, 50)

    return go


def sister(n=1, contig="chr1"):
    return [line for k in range(n) for line in reads_of(contig, 100, 300, 3, 3, codes=("GGG", "TTT"), name=f"s{k}")]


def unique(found):
    return sorted((r["sample"], r["contig"], r["pos"], r["half"], r["allele"]) for r in found.calls.where("unique_mutation").collect())


@pytest.mark.parametrize("kind", ["SUB", "INS", "DEL"])
@pytest.mark.parametrize(("pos", "side"), [(140, "left"), (255, "right")])
def test_a_clean_change_is_called(run, kind, pos, side):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, (kind, pos)), "B": sister()})
    allele = {"SUB": OTHER[CONTIGS["chr1"][pos]], "INS": "^GG^", "DEL": f"-{pos}+2-"}[kind]
    assert unique(found) == [("A", "chr1", pos, kind == "INS", allele)]
    row = found.table().where("flag = '*'").first()
    assert (row["sample"], row["contig"], row["position"]) == ("A", "chr1", pos + 1)


def test_too_few_reads_are_demoted(run):
    found = run({"A": reads_of("chr1", 100, 300, 2, 3, ("SUB", 140)), "B": sister()})
    row = found.support.where(f"sample = 'A' AND pos = 140 AND NOT half AND allele = '{OTHER[CONTIGS['chr1'][140]]}'").first()
    assert (row["n_good"], row["n_good_dubious"]) == (0, 1) and unique(found) == []


@pytest.mark.parametrize(("threshold", "calls"), [(0.75, 1), (0.85, 0)])
def test_consensus_thresholds(run, threshold, calls):
    found = run({"A": reads_of("chr1", 100, 300, 5, 3, ("SUB", 140), mutated=4), "B": sister()}, Params(minNumberDuplexesSisterSamples=1, minConsensusThresholdQ2=threshold))
    assert len(unique(found)) == calls


@pytest.mark.parametrize(("distance", "level"), [(36, 2), (35, 1), (5, 1)])
def test_distance_from_the_ligation_site(run, distance, level):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, ("SUB", 100 + distance)), "B": sister()})
    row = found.molecules.where(f"sample = 'A' AND pos = {100 + distance} AND NOT half").first()
    assert row["quality"] == level


def test_nothing_within_the_first_bases(run):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, ("SUB", 104)), "B": sister()})
    assert found.molecules.where("sample = 'A' AND pos <= 104").count() == 0


def test_strands_that_disagree(run):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, ("SUB", 140), top_only=True), "B": sister()})
    rows = found.disagreements.collect()
    wild = CONTIGS["chr1"][140]
    assert [(r["sample"], r["contig"], r["pos"], r["fst"], r["snd"], r["has_wt"], r["quality"]) for r in rows] == [("A", "chr1", 140, wild, OTHER[wild], True, 2)]
    assert unique(found) == []


def test_a_change_of_two_samples_is_not_unique(run):
    change = ("SUB", 140)
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, change), "B": reads_of("chr1", 100, 300, 3, 3, change)})
    assert unique(found) == []


@pytest.mark.parametrize(("needed", "calls"), [(2, 1), (3, 0)])
def test_sister_coverage(run, needed, calls):
    lines = reads_of("chr1", 100, 300, 3, 3, codes=("GGG", "TTT"), name="x") + reads_of("chr1", 100, 300, 3, 3, codes=("CAG", "ATC"), name="y")
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, ("SUB", 140)), "B": lines}, Params(minNumberDuplexesSisterSamples=needed))
    assert len(unique(found)) == calls


@pytest.mark.parametrize(("code", "n"), [("AAC", 1), ("ACC", 2)])
def test_barcodes_merge_within_a_mismatch(run, code, n):
    lines = reads_of("chr1", 100, 300, 3, 3, name="p") + reads_of("chr1", 100, 300, 2, 2, codes=(code, "CCC"), name="q")
    found = run({"A": lines, "B": sister()})
    assert found.molecules.where("sample = 'A' AND pos = 140 AND NOT half").count() == n


@pytest.mark.parametrize(("shift", "n"), [(5, 1), (6, 2)])
def test_ends_merge_within_the_tolerance(run, shift, n):
    lines = reads_of("chr1", 100, 300, 3, 3, name="p") + reads_of("chr1", 100 + shift, 300, 2, 2, name="q")
    found = run({"A": lines, "B": sister()}, Params(minNumberDuplexesSisterSamples=1, alignmentPositionMismatchAllowed=5))
    assert found.molecules.where("sample = 'A' AND pos = 150 AND NOT half").count() == n


def test_equal_positions_of_two_contigs_are_apart(run):
    """Half of a molecule's reads on each contig is no molecule."""
    one = reads_of("chr1", 100, 300, 3, 0, ("SUB", 140)) + reads_of("chr2", 100, 300, 0, 3, ("SUB", 140))
    found = run({"A": one, "B": sister() + sister(contig="chr2")})
    assert unique(found) == []
    both = run({"A": reads_of("chr1", 100, 300, 3, 3, ("SUB", 140)) + reads_of("chr2", 100, 300, 3, 3, ("SUB", 140)), "B": sister() + sister(contig="chr2")})
    assert [c for _, c, *_ in unique(both)] == ["chr1", "chr2"]


def test_partitions_and_order_do_not_matter(run):
    lines = reads_of("chr1", 100, 300, 3, 3, ("SUB", 140)) + reads_of("chr2", 90, 290, 4, 3, ("INS", 140), codes=("CTA", "GGA"), name="z")
    b = sister() + sister(contig="chr2")
    expected = sorted(map(str, run({"A": lines, "B": b}).table().collect()))
    random.Random(1).shuffle(lines)
    assert sorted(map(str, run({"A": lines, "B": b}, partitions=7).table().collect())) == expected and expected


def test_no_reads_and_reads_without_mates(run, spark):
    lone = reads_of("chr1", 100, 300, 1, 0)[:1]
    found = run({"A": lone})
    assert found.table().count() == 0 and found.molecules.count() == 0


def test_reads_of_a_split_alignment(run, spark):
    """Hard-clipped halves of split pairs, with tags, pass through; pairs of far halves are wrong pairs."""
    lines = [re.sub("70M", "60M10H", line) if "70M" in line else line for line in reads_of("chr1", 100, 300, 1, 1)]
    lines = ["\t".join([*f[:9], f[9][:60], f[10][:60], "XH:Z:ACGT", "SA:Z:chr2,10,+,60H10M,60,0;", "XT:Z:GT-AG,2.00"]) for f in (line.split("\t") for line in lines)]
    found = run({"A": lines})
    assert found.molecules.count() > 0
    far = [line.replace("chr1", "chr2", 1) if k == 0 else line for k, line in enumerate(lines[:2])]
    assert run({"A": far}).molecules.count() == 0


def level(found, pos=140):
    """Quality of sample A's molecule at a place."""
    return found.molecules.where(f"sample = 'A' AND pos = {pos} AND NOT half").first()["quality"]


CHANGED = ("SUB", 140)


def with_quality(lines, letter):
    """All base scores of SAM lines replaced."""
    return ["\t".join([*f[:10], letter * len(f[10]), *f[11:]]) for f in (line.split("\t") for line in lines)]


@pytest.mark.parametrize(
    ("params", "letter", "quality"),
    [({}, "I", 2), ({}, ":", 1), ({"minBasePhredScoreQ2": 20}, ":", 2), ({"minBasePhredScoreQ2": 41}, "I", 1), ({"minMedianPhredScoreAtPosition": 40}, "I", 2),
     ({"minMedianPhredScoreAtPosition": 41}, "I", 1), ({"minCandidateMedianPhredScore": 41}, "I", 1), ({"minCandidateMedianPhredScore": 40}, "I", 2), ({"minMappingQualityQ2": 61}, "I", 1), ({"maxInsertSize": 200}, "I", 1), ({"minInsertSize": 202}, "I", 1)],
)
def test_qualities_of_bases_places_and_molecules(run, params, letter, quality):
    found = run({"A": with_quality(reads_of("chr1", 100, 300, 3, 3, CHANGED), letter), "B": sister()}, Params(minNumberDuplexesSisterSamples=1, **params))
    assert level(found) == quality
    assert (unique(found) != []) == (quality == 2)


@pytest.mark.parametrize(("params", "quality"), [({}, 2), ({"maxAverageBasesClipped": 9}, 1), ({"maxAverageBasesClipped": 10}, 2), ({"maxAverageClippingOfAllCoveringDuplexes": 9}, 1), ({"maxAverageClippingOfAllCoveringDuplexes": 10}, 2)])
def test_clipping(run, params, quality):
    """Ten clipped bases at the inner end of every read."""
    lines = []
    for line in reads_of("chr1", 100, 300, 3, 3, CHANGED):
        f = line.split("\t")
        left = not int(f[1]) & 16
        f[5] = "60M10S" if left else "10S60M"
        f[3] = str(int(f[3]) + (0 if left else 10))
        lines.append("\t".join(f))
    assert level(run({"A": lines, "B": sister()}, Params(minNumberDuplexesSisterSamples=1, **params))) == quality


def tandem(n_top=3):
    """Pairs whose reads lie on one strand."""
    lines = []
    for line in reads_of("chr1", 100, 300, n_top, 0, name="t", codes=("GTG", "CAC")):
        f = line.split("\t")
        lines.append("\t".join([f[0], str(int(f[1]) & ~48), *f[2:]]))
    return lines


def test_wrong_pairs(run):
    lines = reads_of("chr1", 100, 300, 3, 3, CHANGED)
    one = run({"A": lines + tandem(), "B": sister()})
    wrong = one.molecules.where("sample = 'A' AND pos = 150 AND NOT half").select("has_wrong_pair", "quality").collect()
    assert sorted(map(tuple, wrong)) == [(False, 2), (True, 1)]
    assert run({"A": lines + tandem(), "B": sister()}, Params(minNumberDuplexesSisterSamples=1, ignoreTandemRFPairs=True)).molecules.where("has_wrong_pair").count() == 0
    doubted = run({"A": lines + tandem(), "B": sister()}, Params(minNumberDuplexesSisterSamples=1, maxFractionWrongPairsAtPosition=0.2))
    assert doubted.molecules.where("sample = 'A' AND pos = 150 AND NOT half AND quality = 2").count() == 0


def test_constant_barcodes(run):
    lines = [line.replace("CCCTCT", "CCCTCA") for line in reads_of("chr1", 100, 300, 3, 3, CHANGED)]
    strict = lambda n: Params(minNumberDuplexesSisterSamples=1, nConstantBarcodeMismatchesAllowed=n)
    assert run({"A": lines, "B": sister()}, strict(1)).molecules.where("sample = 'A'").count() > 0
    assert run({"A": lines, "B": sister()}, strict(0)).molecules.where("sample = 'A'").count() == 0


def test_records_taken(run):
    lines = reads_of("chr1", 100, 300, 3, 3, CHANGED)
    assert run({"A": lines}, Params(nRecordsToProcess=0)).molecules.count() == 0
    assert run({"A": lines}, Params(dropReadProbability=1.0)).molecules.count() == 0
    zero = ["\t".join([*line.split("\t")[:8], "0", *line.split("\t")[9:]]) for line in lines]
    assert run({"A": zero}).molecules.count() > 0
    assert run({"A": zero}, Params(ignoreZeroInsertSizeReads=True)).molecules.count() == 0


def test_frequencies(run):
    """A change that all molecules of a sample have, against limits of the top allele and of disagreements."""
    lines = reads_of("chr1", 100, 300, 3, 3, CHANGED)
    assert unique(run({"A": lines, "B": sister()})) != []
    assert unique(run({"A": lines, "B": sister()}, Params(minNumberDuplexesSisterSamples=1, maxTopAlleleFreqQ2=0.9))) == []
    both = lines + reads_of("chr1", 100, 300, 3, 3, CHANGED, codes=("GTG", "CAC"), name="d", top_only=True)
    quality = lambda found: [r["quality"] for r in found.disagreements.where("pos = 140").collect()]
    assert quality(run({"A": both, "B": sister()})) == [2]
    capped = quality(run({"A": both, "B": sister()}, Params(minNumberDuplexesSisterSamples=1, maxMutFreqForDisag=0.4)))
    assert len(capped) == 1 and capped[0] < 2


def test_optical_duplicates_in_a_run(run):
    """All reads of a strand on one spot: one of them is left."""
    lines = reads_of("chr1", 100, 300, 3, 3, CHANGED)
    n = lambda found: found.molecules.where("sample = 'A' AND pos = 140 AND NOT half").first()["top_n_strand"]
    assert n(run({"A": lines})) == 3
    assert n(run({"A": lines}, Params(filterOpticalDuplicates=True))) == 1
    assert n(run({"A": lines}, Params(filterOpticalDuplicates=True, opticalDuplicateDistance=1))) == 3


def test_illegal_input_and_parameters(run):
    lines = reads_of("chr1", 100, 300, 1, 0)
    with pytest.raises(Exception, match="more than two reads"):
        run({"A": lines + lines}).molecules.collect()
    with pytest.raises(ValueError, match="requireMatchInAlignmentEnd"):
        run({"A": lines}, Params(requireMatchInAlignmentEnd=True))


def test_calls_by_stretches(run):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, CHANGED), "B": sister()}, Params(minNumberDuplexesSisterSamples=1, contigStatsBinLength=150))
    rows = {(r["sample"], r["bin"]): r["n_calls"] for r in found.by_bin().collect()}
    assert rows[("A", 0)] == 1 and sum(rows.values()) == 1 and ("A", 1) in rows


def test_details_of_calls(run):
    found = run({"A": reads_of("chr1", 100, 300, 3, 3, CHANGED), "B": sister()})
    row = found.details().where("flag = '*'").first()
    assert (row["n_reads"], row["median_phred"], row["min_insert"], row["n_far_mates"], row["n_concurring"], row["has_disagreement"]) == (6, 40, 201, 0, 1, False)
