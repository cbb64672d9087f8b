"""The binary source against SAM text of the same reads, whole and split by its index."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from strandlake.sources import bam, readers


def block(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def encoded(read, contigs) -> bytes:
    name, flag, contig, start, mapq, cigar, mate, mate_start, tlen, seq, qual, tags = read
    ops = [(int(n), o) for n, o in cigar]
    codes = [bam.LETTERS.index(c) for c in seq]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0][: len(codes[::2])], strict=True))
    body = struct.pack("<iiBBHHHiiii", contigs.index(contig), start, len(name) + 1, mapq, 0, len(ops), flag, len(seq), contigs.index(mate), mate_start, tlen)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATORS.index(o)) for n, o in ops) + packed + bytes(ord(q) - 33 for q in qual)
    body += b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in tags.items()) + b"NMi" + struct.pack("<i", 3) + b"XBBs" + struct.pack("<i2h", 2, -1, 5)
    return struct.pack("<i", len(body)) + body


@pytest.fixture
def files(tmp_path):
    rng = random.Random(12)
    contigs = ["c1", "c2"]
    reads = []
    for k in range(400):
        size = rng.randint(20, 40)
        reads.append((f"r{k}", 99, contigs[k // 250], 10 * k, 60, [(5, "S"), (size - 5, "M")], "c1", 10 * k + 100, 150, "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("#5I", k=size)), {"BC": f"A{k}"}))
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + c.encode() + b"\0" + struct.pack("<i", 9999) for c in contigs)
    out, places, pending = block(head), [], b""
    for read in reads:
        if len(pending) > 900:
            # cut inside a record, so that records cross blocks
            out, pending = out + block(pending[:-7]), pending[-7:]
        places.append(len(out) << 16 | len(pending))
        pending += encoded(read, contigs)
    out += block(pending) + block(b"")
    path = tmp_path / "a.bam"
    path.write_bytes(out)
    # a place of a record that begins in the bytes carried over is left out of the index
    named = places[::10]
    index = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<Ii", 4681, len(named)) + b"".join(struct.pack("<QQ", p, p) for p in named) + struct.pack("<i", 0)
    return reads, str(path), index


def rows(frame):
    return sorted((r["qname"], r["flag"], r["contig"], r["start"], r["mapq"], r["cigar"], r["mate_start"], r["tlen"], r["seq"], r["qual"], r["tags"]["BC"], r["tags"]["NM"], r["tags"]["XB"]) for r in frame.collect())


def test_whole_and_split(spark, files, tmp_path):
    reads, path, index = files
    bam.register(spark)
    expected = sorted((n, f, c, s, q, "".join(f"{k}{o}" for k, o in g), ms, t, x, y, z["BC"], "3", "s,-1,5") for n, f, c, s, q, g, _, ms, t, x, y, z in reads)
    whole = spark.read.format("bam").load(path)
    assert rows(whole) == expected and whole.rdd.getNumPartitions() == 1
    (tmp_path / "a.bam.bai").write_bytes(index)
    split = spark.read.format("bam").option("splitBytes", 3000).load(path)
    assert split.rdd.getNumPartitions() > 3 and rows(split) == expected
    assert readers.derived(split).where("effective_length > 0").count() == len(reads)


def test_other_files_fail(spark, lines):
    bam.register(spark)
    with pytest.raises(Exception, match="gzip|BAM|PYTHON_DATA_SOURCE"):
        spark.read.format("bam").load(lines("x.bam", "text")).collect()


CONTIGS = [("c1", 1 << 20), ("c2", 1 << 28), ("c3", 100)]
READ = "qname string, flag int, contig string, start int, mapq int, cigar string, mate_contig string, mate_start int, tlen int, seq string, qual string, tags map<string,string>"


def made(n=3000, seed=4):
    """Reads over two contigs and without one, some long; odd lengths, absent letters and typed tags."""
    rng = random.Random(seed)
    reads = []
    for k in range(n):
        contig = rng.choice(["c1", "c2", "c2", "*"]) if k % 7 else "c2"
        start = -1 if contig == "*" else rng.randrange(900_000) if contig == "c1" else rng.randrange(200_000_000)
        size = rng.randint(1, 60)
        cigar = "*" if contig == "*" else rng.choice([f"{size}M", f"{size}M50000N0M" if size > 3 else f"{size}M", f"{size}S"])
        seq = "*" if k % 50 == 0 else "".join(rng.choices("ACGTN", k=size))
        qual = "*" if seq == "*" or k % 31 == 0 else "".join(rng.choices("#5I!~", k=size))
        tags = {"XI": str(rng.randint(-9, 9)), "XF": "0.5", "XZ": f"ä{k}", "XB": "s,-1,5"} if k % 3 else {}
        reads.append((f"r{k}", 4 if contig == "*" or k % 11 == 0 else 99, contig, start, 60, cigar, "c3", 5, -150, seq, qual, tags))
    return reads


def plain(frame):
    return sorted((*(r[c] for c in frame.columns if c != "tags"), sorted((r["tags"] or {}).items())) for r in frame.select(READ_NAMES).collect())


READ_NAMES = [part.split()[0] for part in READ.split(", ")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam"))
    frame = spark.createDataFrame(made(), READ).repartition(5)
    bam.write_sorted(frame, path, CONTIGS, {"XI": "i", "XF": "f", "XB": "B"})
    sizes = {r["file"]: r["bytes"] for r in bam.write_indexes(spark, path).collect()}
    return path, sizes


def test_sink_round_trip(spark, written):
    path, sizes = written
    import os

    files = [f for f in os.listdir(path) if f.endswith(".bam")]
    assert files and len(sizes) == len(files) and not any("temporary" in f for f in os.listdir(path))
    assert plain(bam.read(spark, path)) == sorted((*r[:-1], sorted(r[-1].items())) for r in made())
    with open(os.path.join(path, files[0]), "rb") as f:
        assert f.read().endswith(bam.END_OF_FILE)


def end_of(read):
    return read[3] + max(1, sum(int(n) for n, o in bam._STEP.findall(read[5]) if o in "MDN=X")) - 1


@pytest.mark.parametrize(("contig", "first", "last"), [("c1", 0, 50), ("c1", 400_000, 410_000), ("c2", 150_000_000, 150_100_000), ("c2", 268_000_000, 268_400_000), ("c3", 0, 99), ("nowhere", 1, 2)])
def test_range_reads_only_its_blocks(spark, written, contig, first, last):
    path, _ = written
    found = sorted(r["qname"] for r in bam.over_range(spark, path, contig, first, last).collect())
    assert found == sorted(r[0] for r in made() if r[2] == contig and r[3] <= last and end_of(r) >= first)
    reader = bam.BamReader(path, 1 << 30)
    everything = sum_of_blocks(reader.partitions())
    list(reader.pushFilters([bam.EqualTo(("contig",), contig), bam.LessThanOrEqual(("start",), last), bam.GreaterThanOrEqual(("ref_end",), first)]))
    assert sum_of_blocks(reader.partitions()) <= max(0.5 * everything, 0)


def sum_of_blocks(pieces):
    import os

    return sum((os.path.getsize(p.path) if p.end is None else (p.end >> 16) + 1) - (p.begin >> 16) for p in pieces)


def test_every_place_is_in_its_index(spark, written):
    """All records of small ranges, by the index against a full scan; the index round-trips through its bytes and rows."""
    path, _ = written
    rng = random.Random(2)
    reads = made()
    for _ in range(6):
        at = rng.randrange(200_000_000)
        frame = bam.read(spark, path).where((bam.F.col("contig") == "c2") & (bam.F.col("start") >= at) & (bam.F.col("start") < at + 3_000_000))
        assert sorted(r["qname"] for r in frame.collect()) == sorted(r[0] for r in reads if r[2] == "c2" and at <= r[3] < at + 3_000_000)
    one = bam.BamReader(path, 1).files[0]
    data = open(one + ".bai", "rb").read()
    assert bam.index_bytes(*bam.read_index(data)) == data
    stats = {r["contig"]: (r["aligned"], r["unaligned"]) for r in bam.index_statistics(spark, path).collect()}
    count = lambda c, flag: sum(1 for r in reads if r[2] == c and (r[1] & 4 != 0) == flag)
    assert stats == {"c1": (count("c1", False), count("c1", True)), "c2": (count("c2", False), count("c2", True)), "*": (0, count("*", True))}
    unplaced = bam.read(spark, path).where("contig = '*'")
    assert unplaced.count() == count("*", True)


def test_failed_task_leaves_nothing(spark, tmp_path):
    """One read has a contig that the header lacks; an earlier result stays as it was."""
    good = made(40)
    path = str(tmp_path / "out")
    bam.write_sorted(spark.createDataFrame(good, READ), path, CONTIGS)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    bad = [*good, ("x", 99, "c9", 5, 60, "1M", "c1", 1, 0, "A", "I", {})]
    with pytest.raises(Exception, match="c9|lacks|WRITE|PYTHON"):
        bam.write_sorted(spark.createDataFrame(bad, READ).repartition(4), path, CONTIGS)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    assert bam.read(spark, path).count() == 40
    bam.write_sorted(spark.createDataFrame(good[:3], READ), path, CONTIGS, mode="append")
    assert bam.read(spark, path).count() == 43


def test_no_reads(spark, tmp_path):
    bam.write_sorted(spark.createDataFrame([], READ), str(tmp_path / "none"), CONTIGS)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0
    assert bam.index_statistics(spark, str(tmp_path / "none")).count() == 0


def odd_reads():
    """Nulls, names of no letter, letters outside ASCII, long and missing parts, numbers at the edges of their kinds."""
    long = "ACGT" * 20_000
    return [
        (None, None, None, None, None, None, "*", None, None, None, None, None),
        ("", 65535, "c1", 0, 255, "1M", "*", -1, -(1 << 31), "A", "~", {}),
        ("ä" * 127, 0, "c2", 5, 0, "*", "c1", 7, 9, "ACN", "I", {"XZ": "", "XI": "-7"}),
        ("n", 1, "c2", (1 << 29) - 9, 1, "9M", "c1", 7, 9, "acx", "III", {"XZ": None, "XF": "1e20", "XB": "f,0.5"}),
        ("l", 1, "c1", 16_000, 1, "60000M20000S", "c1", 7, 9, long, "!" * len(long), {"XZ": "z" * 70_000}),
    ]


@pytest.mark.parametrize("strange", [[], [("q", 0, "c1", 1, 1, "1M", "c1", 1, 1, "A", "\xe9", {})]])
def test_batches_are_coded_as_single_records(strange):
    import numpy as np
    import pyarrow as pa

    from strandlake.sources import bam_records as B

    kinds, contigs = {"XI": "i", "XF": "f", "XB": "B", "XA": "A"}, {n: k for k, (n, _) in enumerate(CONTIGS)} | {"*": -1, None: -1}
    rows = odd_reads() + made(700, 9) + [("t", 4, "c1", 3, 1, "1M", "c1", 1, 1, "A", "I", {"XA": "q", "XI": str(k), "YY": "é"}) for k in range(5)] + strange
    columns = [pa.array([list(r[k].items()) if k == 11 and r[k] is not None else r[k] for r in rows], t) for k, t in enumerate(bam.arrow_schema(False).types)]
    batch = pa.RecordBatch.from_arrays(columns, schema=bam.arrow_schema(False))
    for part in (batch, batch.slice(3, 400), batch.slice(0, 0)):
        data, sizes = B.encoded_batch(part, contigs, kinds)
        plainly = [B.encoded(row, contigs, kinds) for row in part.to_pylist()]
        assert data == b"".join(plainly) and sizes.tolist() == [len(p) for p in plainly]
    data, sizes = B.encoded_batch(batch, contigs, kinds)
    got, last = B.decoded_batch(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, [n for n, _ in CONTIGS])
    assert [(r or 0) for r in got[1].to_pylist()] == [(r[1] or 0) for r in rows] and len(last) == len(rows)
    assert got[9].to_pylist() == [("".join(c if c in bam.LETTERS else "N" for c in r[9]) if r[9] not in (None, "*") else "*") for r in rows]
    assert [dict(t) for t in got[11].to_pylist()] == [{k: {"1e20": str(float(np.float32(1e20)))}.get(v, v) for k, v in (r[11] or {}).items() if v is not None} for r in rows]


def test_a_repeated_tag_holds_its_last_value():
    import numpy as np

    from strandlake.sources import bam_records as B

    data = b"xx" + b"NMi" + struct.pack("<i", 3) + b"RGZa\0" + b"NMi" + struct.pack("<i", 4) + b"RGZ\xff\0"
    got = B.decoded_tags(np.frombuffer(data, np.uint8), np.array([2, len(data) - 5]), np.array([len(data) - 5, len(data)]))
    assert [dict(t) for t in got.to_pylist()] == [{"NM": "4", "RG": "a"}, {"RG": "�"}]
    with pytest.raises(ValueError, match="tag"):
        B.decoded_tags(np.frombuffer(b"RGZab", np.uint8), np.array([0]), np.array([5]))


def test_the_index_is_made_in_one_scan(spark, written):
    """One read of the files makes all kinds of rows, and a file read in many stretches has the same index."""
    path, _ = written
    plan = bam.write_indexes(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
    reader = bam.BamReader(path, 1, parts=True)
    assert len(reader.partitions()) > 3 * len(reader.files)
    for file in reader.files:
        stretches = [p for p in reader.partitions() if p.path == file]
        rows = [row for p in stretches for part in reader.read(p) for row in part.to_pylist()]
        with open(file, "rb") as f:
            names = [n for n, _ in bam.header(bam.Blocks(f, 0))]
        with open(file + ".bai", "rb") as f:
            assert bam.index_bytes(*bam.contigs_from(rows, names)) == f.read()


def test_a_cut_file_fails(spark, written, tmp_path):
    """A file that ends inside a record is an error, however its blocks are read."""
    path, _ = written
    one = open(bam.BamReader(path, 1).files[0], "rb").read()
    blocks = bam.Blocks(open(bam.BamReader(path, 1).files[0], "rb"), 0)
    bam.header(blocks)
    first = blocks.place() >> 16
    (tmp_path / "cut.bam").write_bytes(one[:first] + block(zlib.decompress(one[first + 18 : blocks.next - 8], -15)[:-5]))
    reader = bam.BamReader(str(tmp_path / "cut.bam"), 1)
    with pytest.raises(EOFError):
        list(reader.read(reader.partitions()[0]))


@pytest.mark.parametrize("filters", [[("contig", "=", "c2"), ("start", "<=", 100_000_000), ("ref_end", ">=", 90_000_000)], [("contig", "=", "*")], [("start", "<=", -1)], [("start", ">=", 700_000)], []])
def test_only_fitting_records_are_decoded(spark, written, filters):
    """Of the blocks that an index names, rows come out that the pushed filters keep, and none of these is lost."""
    path, _ = written
    kinds = {"=": bam.EqualTo, "<=": bam.LessThanOrEqual, ">=": bam.GreaterThanOrEqual}
    reader = bam.BamReader(path, 1 << 30, places=True)
    list(reader.pushFilters([kinds[o]((c,), v) for c, o, v in filters]))
    rows = [r for p in reader.partitions() for part in reader.read(p) for r in part.to_pylist()]
    test = {"=": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    of = lambda r: {"contig": r[2], "start": r[3], "ref_end": end_of(r)}
    expected = sorted(r[0] for r in made() if all(test[o](of(r)[c], v) for c, o, v in filters))
    extra = [("start", ">=", 700_000)] == filters  # a read that begins before may still reach into the range
    got = sorted(r["qname"] for r in rows if not extra or r["start"] >= 700_000)
    assert got == expected and len(rows) <= len(expected) + 200
