"""Readers, CIGAR functions and pile-up on hand-made reads, against plain Python."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.functions import sequence as S
from strandlake.operators import molecules, pileup, reads, toolkit
from strandlake.params import Params
from strandlake.sources import readers, sinks


def walk(cigar: str, start: int):
    """(reference place, read place, operator) of every base that an alignment touches."""
    ref, read = start, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                yield ref, read, "M"
            elif op in "DN":
                yield ref, None, op
            elif op in "IS":
                yield None, read, op
            ref += op in "M=XDN"
            read += op in "M=XIS"


CIGARS = ["10M", "3S7M", "4M2D6M", "5M3I2M", "2H3S4M1I2M5N1M2S1H", "1M1D1M1D8M", "10=", "4X6M"]


def test_blocks_and_read_positions(spark):
    rows = spark.createDataFrame([(c, 7) for c in CIGARS], "cigar string, start int")
    made = rows.select("cigar", C.aligned_blocks(F.col("cigar"), F.col("start")).alias("b"), C.reference_end(F.col("cigar"), F.col("start")).alias("e")).collect()
    for row in made:
        seen = [(r, q) for r, q, op in walk(row["cigar"], 7) if op == "M"]
        assert [(b["ref"] + k, b["read"] + k) for b in row["b"] for k in range(b["len"])] == seen
        assert row["e"] == max(r for r, _, _ in walk(row["cigar"], 7) if r is not None)
        for ref, read in seen:
            got = rows.where(F.col("cigar") == row["cigar"]).select(C.read_position(F.col("cigar"), F.col("start"), F.lit(ref)).alias("p"))
            if ref in (seen[0][0], seen[-1][0]):
                assert got.first()["p"] == read


def test_sam_round_trip(spark, lines):
    body = [
        "r1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTN\tIIII#\tBC:Z:ACGTCTA\tSA:Z:chr2,51,-,3S2M,20,0;",
        "r1\t147\tchr1\t201\t60\t2S3M\t=\t101\t-105\tNCGTA\tIIIII",
    ]
    path = lines("a.sam", "@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000", *body)
    rows = readers.sam(spark, path)
    assert sorted(r["value"] for r in sinks.sam_lines(rows).collect())[1].startswith("r1\t99\tchr1\t101\t60\t5M\tchr1\t201\t105\tACGTN\tIIII#\tBC:Z:ACGTCTA")
    first = readers.derived(rows).where("is_first").first()
    assert (first["start"], first["end"], first["effective_length"], first["barcode"]) == (100, 104, 4, "ACGTCTA")
    second = readers.derived(rows).where("NOT is_first").first()
    assert (second["negative"], second["unclipped_start"], second["five_prime"], second["effective_length"]) == (True, 198, 202, 4)
    tag = rows.where("flag = 99").select(C.supplementary(F.col("tags")["SA"]).alias("s")).first()["s"]
    assert (tag["contig"], tag["start"], tag["negative"]) == ("chr2", 50, True)
    assert readers.sam_contigs(spark, path).collect()[0]["length"] == 1000
    kept = readers.overlapping_range(rows, "chr1", 150, 199, 10)
    assert kept.count() == 0


def test_bed_boundaries_and_errors(spark, lines):
    path = lines("a.bed", "#comment", "chr1\t1_1\t20\tg1\t5\t+", "chr1\t31\t40\tg2\t1.5\t-")
    rows = {r["name"]: r for r in readers.bed(spark, path).collect()}
    assert (rows["g1"]["start"], rows["g1"]["end"], rows["g1"]["negative"]) == (10, 19, False)
    assert rows["g2"]["negative"] is True
    with pytest.raises(PySparkException):
        readers.bed(spark, lines("b.bed", "chr1\t1\t2\tg\t0\t?")).collect()
    known = spark.createDataFrame([("chr2",)], "contig string")
    with pytest.raises(PySparkException):
        readers.bed(spark, path, contigs=known).collect()
    assert readers.bed(spark, lines("c.bed", "chr1\t5\t9"), columns=["contig", "start", "end"]).first()["name"].startswith("line_")


def test_lists_and_fasta(spark, lines):
    fasta = lines("a.fa", ">c1 first", "acg", "TTN", ">c2", "GG")
    assert {r["contig"]: r["seq"] for r in readers.fasta(spark, fasta).collect()} == {"c1": "ACGTTN", "c2": "GG"}
    chunks = {(r["contig"], r["chunk"]): r["seq"] for r in pileup.reference_chunks(readers.fasta(spark, fasta), 4).collect()}
    assert chunks == {("c1", 0): "ACGT", ("c1", 1): "TN", ("c2", 0): "GG"}
    places = readers.positions(spark, lines("p.txt", "chr1:1,234 chr2:5-7", "chr1:10.5"))
    assert sorted((r["contig"], r["pos"], r["half"]) for r in places.collect()) == [("chr1", 9, True), ("chr1", 1233, False), ("chr2", 4, False), ("chr2", 5, False), ("chr2", 6, False)]
    listed = readers.mutation_list(spark, lines("m.tsv", "s\t1\t1,001\tAT\tnote", "s\tchrX\t5\t-AC-", "s\tY\t5\t^G^"))
    assert sorted((r["contig"], r["pos"], r["kind"], r["sequence"]) for r in listed.collect()) == [("chr1", 1000, "SUBSTITUTION", "T"), ("chrX", 4, "DELETION", "AC"), ("chrY", 4, "INSERTION", "G")]
    names = readers.name_map(spark, lines("n.tsv", "t1\tg1\ta", "t1\tg2\tb"))
    assert names.first()["names"] == ["g1", "g2"] and names.first()["extras"] == ["a", "b"]


def test_fastq_zip_and_mismatch(spark, lines):
    one = lines("1.fq", *[x for k in range(9) for x in (f"@r{k} 1", "ACGT", "+", "IIII")])
    two = lines("2.fq", *[x for k in range(9) for x in (f"@r{k} 2", "TTTT", "+", "IIII")])
    both = readers.zipped_fastq(readers.fastq(spark, one), readers.fastq(spark, two)).orderBy("record").collect()
    assert [r["name_1"] for r in both] == [f"r{k} 1" for k in range(9)] and both[3]["seq_2"] == "TTTT"
    odd = lines("3.fq", "@x", "A", "+", "I")
    with pytest.raises(PySparkException):
        readers.zipped_fastq(readers.fastq(spark, one), readers.fastq(spark, odd)).collect()


def test_observed_bases(spark):
    reference = spark.createDataFrame([("c", 0, "ACGTACGTACGTACGT")], "contig string, chunk int, seq string")
    rows = [("a", "c", 2, "GTAC", "IIII", "4M"), ("b", "c", 2, "GTTAC", "IIIII", "2M1I2M"), ("d", "c", 2, "GTCG", "IIII", "2M2D2M"), ("e", "c", 2, "GAAC", "IIII", "4M")]
    seen = pileup.observed(spark.createDataFrame(rows, "name string, contig string, start int, seq string, qual string, cigar string"), ["name"], reference)
    found = {(r["name"], r["pos"], r["half"], r["kind"], r["seq"], r["hidden"]) for r in seen.collect()}
    assert ("e", 3, False, "SUBSTITUTION", "A", False) in found
    assert ("b", 3, True, "INSERTION", "T", False) in found
    assert ("d", 4, False, "DELETION", "4+2", False) in found and ("d", 5, False, "DELETION", "4+2", True) in found
    assert {x for x in found if x[0] == "a" and not x[2]} == {("a", p, False, "WILDTYPE", b, False) for p, b in zip(range(2, 6), "GTAC", strict=True)}
    assert sum(x[0] == "a" and x[2] for x in found) == 3


@pytest.mark.parametrize(("size", "overlap"), [(10_000, 1_000), (7, 3), (5, 1)])
def test_observed_bases_in_chunks(spark, size, overlap):
    """Chunks and pieces of any size give the bases that a walk along the alignment gives."""
    rng = random.Random(size)
    contig = "".join(rng.choices("ACGT", k=60))
    rows = []
    for k in range(40):
        cigar = rng.choice(["12M", "3S9M", "5M2I5M", "6M4D6M", "4M9N8M", "2M1I2M1D5M2S", "12X"])
        length = sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if op in "MIS=X")
        rows.append((k, "c", rng.randint(0, 52), "".join(rng.choices("ACGT", k=length)), "I" * length, cigar))
    reference = pileup.reference_chunks(spark.createDataFrame([("c", contig)], "contig string, seq string"), size, overlap)
    frame = spark.createDataFrame(rows, "name int, contig string, start int, seq string, qual string, cigar string")
    seen = pileup.observed(frame, ["name"], reference, size=size, overlap=overlap)
    got = sorted((r["name"], r["pos"], r["kind"], r["seq"], r["wt"]) for r in seen.where("NOT half AND kind IN ('WILDTYPE', 'SUBSTITUTION')").collect())
    expected = []
    for name, _, start, seq, _, cigar in rows:
        for ref, read, op in walk(cigar, start):
            if op == "M" and ref < len(contig):
                expected.append((name, ref, "WILDTYPE" if seq[read] == contig[ref] else "SUBSTITUTION", seq[read], contig[ref]))
    assert got == sorted(expected)
    gone = seen.where("kind IN ('DELETION', 'INTRON')").groupBy("name").agg(F.count("*").alias("n"), F.count_if(~F.col("hidden")).alias("first")).collect()
    assert {r["name"]: (r["n"], r["first"]) for r in gone} == {r[0]: (sum(op in "DN" for _, _, op in walk(r[5], 0)), 1) for r in rows if re.search("[DN]", r[5])}
    assert seen.where("kind = 'INSERTION'").count() == sum("I" in r[5] for r in rows)
    blocks = sum(len([x for x in re.findall(r"(\d+)([M=X])", r[5])]) for r in rows)
    bases = sum(op == "M" for r in rows for _, _, op in walk(r[5], 0))
    assert seen.where("half AND kind = 'WILDTYPE'").count() == bases - blocks


def test_filters_and_duplicates(spark):
    rows = spark.createDataFrame([("q", 5, 3, "5M"), ("q", 9, 3, "5M")], "qname string, mapq int, start int, cigar string")
    assert reads.one_per_key(rows, ["qname"]).first()["mapq"] == 9
    with pytest.raises(PySparkException):
        reads.one_per_key(rows, ["qname"], "fail").collect()
    pairs = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("qname"), F.lit(65).alias("flag"))
    dropped = reads.drop_pairs(pairs, 0.3)
    counts = [r["count"] for r in dropped.groupBy("qname").count().collect()]
    assert set(counts) == {2} and 600 < len(counts) < 800
    swapped = reads.random_mate_order(pairs, 1).groupBy("qname").agg(F.countDistinct("flag").alias("n")).agg(F.max("n")).first()[0]
    assert swapped == 1


def differs(a, b):
    return sum(x != y and "N" not in (x, y) for x, y in zip(a, b, strict=True))


def test_fuzzy_merge_against_loop(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 6), 100 + rng.randint(0, 6), "".join(rng.choices("ACN", k=3)), "".join(rng.choices("AC", k=3)), rng.randint(0, 5), rng.randint(0, 5), 0) for k in range(80)]
    schema = "molecule long, left_start int, right_end int, left_bc string, right_bc string, n_top long, n_bottom long, chunk int"
    order = sorted(rows, key=lambda r: (-(r[5] + r[6]), -min(r[5], r[6]), r[1], r[2], r[3], r[4], r[0]))
    kept, expected = [], {}
    for r in order:
        into = next((k for k in kept if max(abs(k[1] - r[1]), abs(k[2] - r[2])) <= 1 and differs(k[3], r[3]) <= 1 and differs(k[4], r[4]) <= 1), None)
        if into is None:
            kept.append(r)
        expected[r[0]] = (into or r)[0]
    for parts in (1, 7):
        got = molecules.fuzzy_merge(spark.createDataFrame(rows, schema).repartition(parts), 1, 1, ["chunk"])
        assert {r["molecule"]: r["merged_into"] for r in got.collect()} == expected


def test_optical_duplicates(spark):
    rows = [(1, "m", "t", 0, 0, 30), (2, "m", "t", 9, 0, 35), (3, "m", "t", 18, 0, 20), (4, "m", "t", 28, 0, 10), (5, "m", "u", 9, 0, 5)]
    made = molecules.optical_duplicates(spark.createDataFrame(rows, "read_id long, molecule string, run_tile string, x int, y int, avg_phred int"), 10, ["molecule"])
    assert {r["read_id"]: r["optical_duplicate"] for r in made.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        S.reverse_complement(F.lit("ACGTNY")).alias("rc"),
        S.mismatches(F.lit("ACN"), F.lit("AGT"), 3).alias("d"),
        S.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))).alias("m"),
        S.upper_median(F.array().cast("array<int>")).alias("none"),
        S.adapter_start(F.lit("ACGTAGATCGGAAG"), "AGATCGGAAGAG").alias("a"),
    ).first()
    assert (row["rc"], row["d"], row["m"], row["none"], row["a"]) == ("RNACGT", 1, 3, None, 5)


def test_library_size():
    size = toolkit.library_size(1000, 900)
    assert abs(900 / size - 1 + __import__("math").exp(-1000 / size)) < 1e-3
    assert toolkit.library_size(10, 10) is None


def test_parameters():
    made = Params.parse(["-minMappingQualityQ1", "30", "-filterOpticalDuplicates"])
    assert made.minMappingQualityQ1 == 30 and made.filterOpticalDuplicates
    with pytest.raises(ValueError):
        Params.parse(["-nothing", "1"])
    with pytest.raises(ValueError):
        Params(minInsertSize=5, maxInsertSize=1).validated()
    assert [p.minMappingQualityQ2 for p in Params().sweep("minMappingQualityQ2", 0, 60, 3)] == [0, 30, 60]


def greedy(rows, tolerance, most):
    """Each row in turn, into the first earlier one that stays and is compatible."""
    order = sorted(rows, key=lambda r: (-(r[5] + r[6]), -min(r[5], r[6]), r[1], r[2], r[3], r[4], r[0]))
    kept, made = [], {}
    for r in order:
        into = next((k for k in kept if k[7] == r[7] and max(abs(k[1] - r[1]), abs(k[2] - r[2])) <= tolerance and differs(k[3], r[3]) <= most and differs(k[4], r[4]) <= most), None)
        if into is None:
            kept.append(r)
        made[r[0]] = (into or r)[0]
    return made


MERGE = "molecule long, left_start int, right_end int, left_bc string, right_bc string, n_top long, n_bottom long, chunk int"


@pytest.mark.parametrize(("tolerance", "most", "letters", "size"), [(0, 0, "ACGT", 3), (0, 1, "ACGTN", 3), (2, 1, "AC", 4), (3, 2, "ACGN", 6), (1, 1, "A", 0), (5, 3, "ACGT", 2)])
def test_rounds_of_merging_equal_one_pass(spark, tolerance, most, letters, size):
    rng = random.Random(tolerance * 10 + most)
    rows = [(k, rng.randint(-9, 12), 100 + rng.randint(0, 9), "".join(rng.choices(letters, k=size)), "".join(rng.choices(letters, k=size)), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 1)) for k in range(160)]
    got = molecules.fuzzy_merge(spark.createDataFrame(rows, MERGE).repartition(5), tolerance, most, ["chunk"])
    assert {r["molecule"]: r["merged_into"] for r in got.collect()} == greedy(rows, tolerance, most)


def test_a_long_chain_of_merging(spark):
    """Every molecule is compatible with its neighbours only and waits for the one before it."""
    rows = [(k, k, 100 + k, "AAA", "AAA", 100 - k, 0, 0) for k in range(24)]
    got = molecules.fuzzy_merge(spark.createDataFrame(rows, MERGE), 1, 0, ["chunk"])
    assert {r["molecule"]: r["merged_into"] for r in got.collect()} == greedy(rows, 1, 0)
    none = molecules.fuzzy_merge(spark.createDataFrame([], MERGE), 1, 1, ["chunk"])
    assert none.count() == 0 and "merged_into" in none.columns


@pytest.mark.parametrize("stretch", [4, 1 << 16])
def test_islands_of_starts(spark, stretch):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), rng.choice(["c1", "c2"]), rng.randint(-40, 90), k) for k in range(70)]
    expected, count = {}, {}
    for s, c, at in sorted({r[:3] for r in rows}):
        last = max((x for (s2, c2, x) in expected if (s2, c2) == (s, c)), default=None)
        count[s, c] = count.get((s, c), 0) + (last is None or at - last > 3)
        expected[s, c, at] = count[s, c]
    found = molecules.start_islands(spark.createDataFrame(rows, "sample string, contig string, left_start int, k int"), 3, stretch)
    assert {(r["sample"], r["contig"], r["left_start"]): r["island"] for r in found.collect()} == expected
    assert found.count() == 70


def test_counted_equals_the_rows_of_all_bases(spark):
    """Sums by numpy and steps against a row for each base: all CIGAR kinds, IUPAC letters, ends of contigs, short scores."""
    rng = random.Random(7)
    rows = []
    for k in range(120):
        parts = []
        for op in rng.choice(["M", "SM", "MIM", "MDM", "MNM", "MIMDMNMS", "=XM", "HMS"]):
            parts.append((rng.randint(1, 9), op))
        size = sum(n for n, op in parts if op in "MIS=X")
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(rng.choices("#5I", k=size if k % 9 else max(size - 3, 0)))
        rows.append((f"r{k}", rng.choice(["c", "d", "absent"]), rng.randint(0, 70), seq, qual, "".join(f"{n}{op}" for n, op in parts)))
    contigs = [(c, "".join(rng.choices("ACGTYRW", k=80))) for c in "cd"]
    reference = pileup.reference_chunks(spark.createDataFrame(contigs, "contig string, seq string"), 10, 6)
    frame = spark.createDataFrame(rows, "name string, contig string, start int, seq string, qual string, cigar string").repartition(3)
    for last in (0, 4):
        plain = pileup.pileup(pileup.observed(frame, [], reference, last, 10, 6), [])
        found = pileup.counted(frame, reference, last, 10, 6)
        columns = ["contig", "pos", "half", "kind", "seq", "n_reads", "phred_sum", "hidden"]
        assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    places = {}
    for _, contig, start, _, _, cigar in rows:
        at = start
        for n, op in [(int(n), op) for n, op in __import__("re").findall(r"(\d+)(\D)", cigar)]:
            for p in range(at, at + n if op in "M=X" else at):
                places[contig, p] = places.get((contig, p), 0) + 1
            at += n if op in "M=XDN" else 0
    assert {(r["contig"], r["pos"]): (r["depth"], r["excluded"]) for r in pileup.depth(frame, 2).collect()} == {k: (min(n, 2), max(n - 2, 0)) for k, n in places.items()}
    assert pileup.counted(frame.limit(0), reference).count() == 0


def test_optical_chains_over_cells_and_molecules(spark, monkeypatch):
    """Random spots in several molecules, shared spots and missing ones, against all pairs; a few spots a bucket."""
    import random

    monkeypatch.setattr(molecules, "SPOTS", 40)
    monkeypatch.setattr(molecules, "PAIRS", 50)
    draw = random.Random(5)
    rows = [(k, draw.choice("mno"), draw.choice(["t", None]), draw.randrange(90) if k % 19 else None, draw.randrange(90), draw.randrange(9)) for k in range(400)]
    made = molecules.optical_duplicates(spark.createDataFrame(rows, "read_id long, molecule string, run_tile string, x int, y int, avg_phred int"), 7, ["molecule"])
    chain = {r[0]: r[0] for r in rows}
    close = [(a, b) for a in rows for b in rows if a[1:3] == b[1:3] and None not in (a[3], b[3]) and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 < 49]
    for _ in rows:
        for a, b in close:
            chain[a[0]] = chain[b[0]] = min(chain[a[0]], chain[b[0]])
    best = {}
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        best.setdefault(chain[r[0]], r[0])
    assert {r["read_id"]: r["optical_duplicate"] for r in made.collect()} == {r[0]: best[chain[r[0]]] != r[0] for r in rows}


def test_optical_calls_do_not_grow_with_molecules(spark, monkeypatch):
    """Two spots in each of 2,000 molecules, and all of them in one call to Python."""
    calls = spark.sparkContext.accumulator(0)
    plain = molecules._chains

    def counted(*given):
        calls.add(1)
        return plain(*given)

    monkeypatch.setattr(molecules, "_chains", counted)
    rows = spark.range(4000).selectExpr("id AS read_id", "id div 2 AS molecule", "'t' AS run_tile", "CAST(id % 2 AS INT) AS x", "0 AS y", "30 AS avg_phred")
    assert molecules.optical_duplicates(rows, 10, ["molecule"]).where("optical_duplicate").count() == 2000
    assert calls.value == 1


def test_fastq_files_that_are_cut_and_packed(spark, tmp_path):
    """Several files, each of several partitions, the rests of which share one: records stay whole and in order."""
    folder, expected = tmp_path / "fastq", []
    folder.mkdir()
    for k, size in enumerate((37, 5, 61, 20)):
        names = [f"f{k}r{i:03d} {'x' * (i % 7)}" for i in range(size)]
        (folder / f"part-{k}.fastq").write_text("".join(f"@{n}\nACGT{n[:4].upper()}\n+\n{n[:4]}\n" for n in names))
        expected += [(n, f"ACGT{n[:4].upper()}", n[:4]) for n in names]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = readers.fastq(spark, str(folder)).orderBy("record").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r)[1:] for r in got] == expected


def test_compatible_molecules_against_all_pairs(spark):
    """Ends around bins' edges, places below zero, barcodes of other lengths and with N."""
    draw = random.Random(8)
    code = lambda: "".join(draw.choice("AC" if draw.random() < 0.97 else "NG") for _ in range(draw.choice([3, 3, 3, 3, 2])))
    rows = [(f"m{k:03d}", draw.choice("xy"), draw.randrange(-9, 30), draw.randrange(-9, 30), code(), code()) for k in range(400)]
    frame = spark.createDataFrame(rows, "molecule string, k string, left_start long, right_end long, left_bc string, right_bc string")
    differ = lambda x, y: sum(a != b and "N" not in (a, b) for a, b in zip(x, y, strict=False))
    for tolerance, letters in ((0, 1), (2, 1), (3, 0), (2, 4)):
        got = sorted(map(tuple, molecules.compatible_molecules(frame, tolerance, letters, ["k"]).collect()))
        near = lambda a, b: a[1] == b[1] and max(abs(a[2] - b[2]), abs(a[3] - b[3])) <= tolerance and max(differ(a[4], b[4]), differ(a[5], b[5])) <= letters  # noqa: B023, E731
        assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)]


def test_optical_duplicates_make_no_checkpoint(spark, monkeypatch):
    """Reads move once by molecule and tile; two of three spots are close, and a hot spot has many reads."""

    def refused(_):
        raise AssertionError("a checkpoint")

    monkeypatch.setattr(molecules, "cut", refused)
    rows = spark.range(9000).selectExpr("id AS read_id", "id div 300 AS molecule", "'t' AS run_tile", "CAST(id % 3 * 5 + IF(id % 3 = 2, 90, 0) AS INT) AS x", "0 AS y", "CAST(id % 50 AS INT) AS avg_phred")
    made = molecules.optical_duplicates(rows, 10, ["molecule"])
    assert made._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert made.where("NOT optical_duplicate").count() == 60
    best = {r["read_id"] for r in made.where("NOT optical_duplicate AND molecule = 0").collect()}
    near = [k for k in range(300) if k % 3 < 2]
    assert best == {max(near, key=lambda k: (k % 50, -k)), max((k for k in range(300) if k % 3 == 2), key=lambda k: (k % 50, -k))}


def test_compatible_molecules_are_shuffled_once(spark):
    """No join of exploded rows: one exchange, of the rows and of those near a bin's end twice."""
    rows = spark.range(6000).selectExpr("id AS molecule", "0 AS chunk", "id % 500 AS left_start", "id % 500 + 90 AS right_end", "'ACG' AS left_bc", "substring('ACGTCA', id % 3 + 1, 3) AS right_bc", "id % 7 AS n_top", "id % 5 AS n_bottom")
    plan = lambda frame: frame._jdf.queryExecution().sparkPlan().toString()
    pairs = plan(molecules.compatible_molecules(rows, 2, 1, ["chunk"]))
    assert pairs.count("Exchange") == 1 and "Join" not in pairs
    assert plan(molecules.fuzzy_merge(rows, 0, 1, ["chunk"])).count("Exchange") == 1
    near = molecules._by_bins(rows, 2, ["chunk"], lambda table, bins: [pa.table({"n": [table.num_rows]})], "n long")
    assert 6000 <= near.agg(F.sum("n")).first()[0] < 6200


@pytest.mark.parametrize(("tolerance", "seed"), [(1, 0), (2, 1), (3, 2)])
def test_merging_over_the_ends_of_small_bins(spark, monkeypatch, tolerance, seed):
    """Bins hardly wider than the tolerance, few rows in one go, few pairs at once."""
    for name, value in (("BINS_WIDE", 2), ("ROWS", 12), ("PAIRS", 7)):
        monkeypatch.setattr(molecules, name, value)
    rng = random.Random(seed)
    rows = [(k, rng.randint(-20, 40), 100 + rng.randint(0, 4), rng.choice(["AC", "AG", "NC"]), rng.choice(["TT", "TC"]), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 1)) for k in range(200)]
    frame = spark.createDataFrame(rows, MERGE).repartition(4)
    assert {r["molecule"]: r["merged_into"] for r in molecules.fuzzy_merge(frame, tolerance, 0, ["chunk"]).collect()} == greedy(rows, tolerance, 0)
    got = sorted(map(tuple, molecules.compatible_molecules(frame, tolerance, 0, ["chunk"]).collect()))
    near = lambda a, b: a[7] == b[7] and max(abs(a[1] - b[1]), abs(a[2] - b[2])) <= tolerance and not differs(a[3], b[3]) and not differs(a[4], b[4])
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)]


def test_adapter_places_are_those_of_every_start():
    """Against a plain search of each start; the edits of many texts' places are counted together."""
    import random

    from strandlake.functions import sequence as S

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
        return row[-1]

    def plainly(text, adapter, most, least):
        fits = []
        for k in range(1, max(len(text or "") - least + 1, 1) + 1):
            rest = min(len(text or "") - k + 1, len(adapter))
            edits = distance((text or "")[k - 1 : k - 1 + rest], adapter[:rest])
            if rest >= least and edits * len(adapter) <= most * rest:
                fits.append((edits / rest, k))
        return min(fits)[1] if fits else None

    rng = random.Random(3)
    texts = [None, "", "GATC", "GATCG", "ä" * 9 + "GATCGGAA", "GATCGGAA" * 3] + ["".join(rng.choices("ACGTN", k=rng.randrange(40))) for _ in range(400)]
    for adapter, most, least in (("GATCGGAA", 3, 5), ("GATCGGAAGAGC", 2, 1), ("GA", 1, 2)):
        assert S._adapter_places(texts, adapter, most, least) == [plainly(t, adapter, most, least) for t in texts]


def test_blocks_are_made_once_for_a_position(spark):
    """The plan names a CIGAR's elements once a position, and not at all as blocks for a split read's longest match."""
    rows = spark.createDataFrame([("3S5M2D4M1S", 10), ("4S", 1)], "cigar string, start int")
    place = rows.select(C.read_position(F.col("cigar"), F.col("start"), F.lit(16)).alias("v"))
    assert place._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["v"] for r in place.collect()] == [8, None]
    split = rows.select(C.split_read(F.col("cigar"), F.col("start"))["matched"].alias("v"))
    assert "aggregate" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert [r["v"] for r in split.collect()] == [5, None]


@pytest.mark.parametrize("seed", [0, 1])
def test_merging_of_molecules_named_once(spark, monkeypatch, seed):
    """The rows of the merge by name, and its mismatches; with nulls, several bins, and few rows in one go."""
    for name, value in (("BINS_WIDE", 3), ("ROWS", 12), ("PAIRS", 7)):
        monkeypatch.setattr(molecules, name, value)
    rng = random.Random(seed)
    letters = ["ACG", "ACC", "NCG", "AC", "TTT", "", None]
    number = lambda *some: rng.choice(some)
    rows = [(k or None, number(1, 2, 2, 5, None), number(101, 101, 101, None), rng.choice(letters), rng.choice(letters[:3]), number(0, 1, None), rng.randint(0, 3), rng.randint(0, 1)) for k in range(150)]
    frame = spark.createDataFrame(rows, MERGE).repartition(4)
    by_name, whole = molecules.fuzzy_merge(frame, 0, 1, ["chunk"]), molecules.fuzzy_merge(frame, 0, 1, ["chunk"], named_once=True)
    assert whole.columns == [*by_name.columns, "target_bc"]
    assert sorted(map(tuple, whole.drop("target_bc").collect()), key=str) == sorted(map(tuple, by_name.collect()), key=str)
    mismatches = [sorted(map(tuple, molecules.merged_barcode_mismatches(frame, merged, 3).collect())) for merged in (by_name, whole)]
    assert mismatches[0] == mismatches[1] != []


def test_names_that_come_twice_are_joined_by_name(spark):
    rows = [(1, 0, 100, "AAA", "AAA", 9, 9, 0), (2, 0, 100, "AAC", "AAA", 1, 1, 0), (2, 0, 100, "AAG", "AAA", 1, 1, 0), (3, 0, 100, "TTT", "AAA", 5, 5, 0)]
    frame = spark.createDataFrame(rows, MERGE)
    merged = molecules.fuzzy_merge(frame, 0, 1, ["chunk"])
    assert sorted((r["molecule"], r["left_bc"], r["merged_into"]) for r in merged.collect()) == [(1, "AAA", 1), (2, "AAC", 1), (2, "AAC", 1), (2, "AAG", 1), (2, "AAG", 1), (3, "TTT", 3)]
    assert sorted(map(tuple, molecules.merged_barcode_mismatches(frame, merged, 3).collect())) == [(3, "A", "C", 2), (3, "A", "G", 2)]


def test_mismatches_of_molecules_named_once_need_no_join(spark):
    rows = spark.createDataFrame([(1, 0, 100, "AAA", "AAA", 9, 9, 0), (None, None, 100, "AAC", "AAA", 1, 1, 0)], MERGE)
    made = molecules.merged_barcode_mismatches(rows, molecules.fuzzy_merge(rows, 0, 1, ["chunk"], named_once=True), 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "Union" not in plan
