"""Readers of alignments, intervals, sequences and lists, as DataFrames over Spark's text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar as C
from ..functions import sequence as S

#: Mandatory fields of a SAM line, in order.
SAM_FIELDS = ["qname", "flag", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "tlen", "seq", "qual"]

READS = T.StructType(
    [T.StructField(n, T.IntegerType() if n in ("flag", "start", "mapq", "mate_start", "tlen") else T.StringType()) for n in SAM_FIELDS]
    + [T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]
)


def sam(spark: SparkSession, path: str | list[str], sample: str | None = None) -> DataFrame:
    """Reads of SAM text files."""
    return sam_rows(spark.read.text(path), sample)


def sam_rows(text: DataFrame, sample: str | None = None) -> DataFrame:
    """Reads of SAM lines (value): positions 0-based, tags as a map, `=` resolved, header lines left out."""
    lines = text.where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    parts = F.split("value", "\t")
    tags = F.map_from_entries(
        F.transform(F.slice(parts, 12, 1_000_000), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6)).alias("v")))
    )
    cols = [F.get(parts, F.lit(k)).try_cast("int").alias(n) if n in ("flag", "mapq", "tlen") else (F.get(parts, F.lit(k)).try_cast("int") - 1).alias(n) if n.endswith("start") else F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(SAM_FIELDS)]
    rows = lines.select(*cols, tags.alias("tags"))
    rows = rows.withColumn("mate_contig", F.when(F.col("mate_contig") == "=", F.col("contig")).otherwise(F.col("mate_contig")))
    return rows if sample is None else rows.withColumn("sample", F.lit(sample))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of the header's @SQ lines."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("@SQ")))
    return lines.select(F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", "\tLN:(\\d+)", 1).cast("long").alias("length"))


def overlapping_range(reads: DataFrame, contig: str, first: int, last: int, max_insert: int) -> DataFrame:
    """Reads of one contig that overlap [first - max_insert + 1, last]; a filter that Parquet can prune by."""
    early = F.col("start") <= last
    return reads.where((F.col("contig") == contig) & early & (C.reference_end(F.col("cigar"), F.col("start")) >= first - max_insert + 1))


def derived(reads: DataFrame) -> DataFrame:
    """Reads with the scalar columns that later operators use."""
    neg, start, cigar = F.col("flag").bitwiseAND(F.lit(16)) != 0, F.col("start"), F.col("cigar")
    phred = S.phreds(F.col("qual"))
    return reads.withColumns(
        {
            "negative": neg,
            "is_first": F.col("flag").bitwiseAND(F.lit(64)) != 0,
            "end": C.reference_end(cigar, start),
            "unclipped_start": C.unclipped_start(cigar, start),
            "unclipped_end": C.unclipped_end(cigar, start),
            "five_prime": F.when(neg, C.unclipped_end(cigar, start)).otherwise(C.unclipped_start(cigar, start)),
            "effective_length": S.effective_length(F.col("seq"), neg),
            "median_phred": S.upper_median(phred),
            "mean_phred": S.integer_mean(phred),
            "insert_size": F.col("tlen"),
            "barcode": F.coalesce(F.try_element_at("tags", F.lit("BC")), S.name_barcode(F.col("qname"))),
        }
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq) of a FASTA file, upper-cased.

    Each file is read as records that begin with `>`, so files of many contigs are split by contig.
    """
    return fasta_rows(spark.read.option("lineSep", ">").text(path))


def fasta_rows(text: DataFrame) -> DataFrame:
    """(contig, seq) of FASTA records (value) without their `>`."""
    records = text.where(F.length("value") > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", ""))
    return records.select(name.alias("contig"), seq.alias("seq"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, length long, offset long, line_bases int, line_width int")


def _whole_number(text: Column) -> Column:
    return F.regexp_replace(text, "_", "").cast("long")


def bed(spark: SparkSession, path: str, columns: list[str] | None = None, contigs: DataFrame | None = None, shift: int = -1) -> DataFrame:
    """Intervals (name, contig, start, end, score, negative) of a BED file.

    Both ends are moved by `shift`, so that intervals are closed. Default columns: contig, start,
    end, name, score, strand. Digits may hold `_`. A strand other than + and -, and a contig that
    `contigs` lacks, are errors. Files of three columns get names by place.
    """
    return bed_rows(spark.read.text(path), columns, contigs, shift)


def bed_rows(text: DataFrame, columns: list[str] | None = None, contigs: DataFrame | None = None, shift: int = -1) -> DataFrame:
    """Intervals of BED lines (value); see `bed`."""
    names = columns or ["contig", "start", "end", "name", "score", "strand"]
    lines = text.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    field = lambda n: F.try_element_at(parts, F.lit(names.index(n) + 1)) if n in names else F.lit(None).cast("string")
    strand = field("strand")
    bad = F.raise_error(F.concat(F.lit("bad strand in line "), F.col("value"))).cast("boolean")
    rows = lines.select(
        F.coalesce(F.regexp_replace(field("name"), '"', ""), F.concat(F.lit("line_"), F.xxhash64("value").cast("string"))).alias("name"),
        field("contig").alias("contig"),
        (_whole_number(field("start")) + shift).alias("start"),
        (_whole_number(field("end")) + shift).alias("end"),
        field("score").try_cast("double").alias("score"),
        F.when(strand.isNull() | (strand == "."), F.lit(None).cast("boolean")).when(strand == "-", True).when(strand == "+", False).otherwise(bad).alias("negative"),
    )
    if contigs is None:
        return rows
    known = rows.join(contigs.select("contig", F.lit(True).alias("__known")), "contig", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown contig "), F.col("contig")))
    return known.withColumn("contig", F.when(F.col("__known"), F.col("contig")).otherwise(unknown.cast("string"))).select(*rows.columns)


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, names, extras): sets of second and further columns of a tab-separated file."""
    return name_map_rows(spark.read.text(path))


def name_map_rows(text: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    rows = text.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("id"), F.try_element_at(parts, F.lit(2)).alias("name"), F.slice(parts, 3, 1_000_000).alias("extra"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("extra")))).alias("extras"))


def mutation_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample, contig, pos, kind, wildtype, sequence, note) of a list to annotate; bare numbers become chrN."""
    return mutation_rows(spark.read.text(path))


def mutation_rows(text: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    contig = F.when(F.get(parts, F.lit(1)).rlike(r"^(\d+|X|Y)$"), F.concat(F.lit("chr"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(1)))
    kind, wildtype, sequence = S.parse_change(F.col("change"))
    rows = text.where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).alias("sample"), contig.alias("contig"), (_whole_number(F.regexp_replace(F.get(parts, F.lit(2)), ",", "")) - 1).alias("pos"), F.get(parts, F.lit(3)).alias("change"), F.try_element_at(parts, F.lit(5)).alias("note")
    )
    return rows.select("sample", "contig", "pos", kind.alias("kind"), wildtype.alias("wildtype"), sequence.alias("sequence"), "note")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, half) of a text file with several `chr:1,234` or `chr:5-9` a line."""
    return position_rows(spark.read.text(path))


def position_rows(text: DataFrame) -> DataFrame:
    words = text.select(F.explode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("w"))
    first = F.regexp_replace(F.regexp_extract("w", r":([\d,]+)", 1), ",", "").cast("long") - 1
    last = F.regexp_replace(F.regexp_extract("w", r"-([\d,]+)$", 1), ",", "").try_cast("long") - 1
    span = F.explode(F.sequence(first, F.coalesce(last, first))).alias("pos")
    return words.select(F.substring_index("w", ":", 1).alias("contig"), F.endswith("w", F.lit(".5")).alias("half"), span).select("contig", "pos", "half")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, seq, qual) in file order.

    Records are found by Spark itself: lines are numbered within the pieces of files that tasks read, and
    pieces' first numbers come from their line counts, so that files of any size are read in parallel.
    A partition may hold pieces of several files in any order, so pieces go by file and place.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    pieces = lines.groupBy("part", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least")).collect()
    first, begins = 0, []
    for piece in sorted(pieces, key=lambda r: (r["file"], r["block"])):
        begins.append((piece["part"], piece["file"], piece["block"], first - piece["least"]))
        first += piece["n"]
    offsets = spark.createDataFrame(begins, "part int, file string, block long, shift long")
    numbered = lines.join(F.broadcast(offsets), ["part", "file", "block"]).withColumn("line", F.col("at") + F.col("shift"))
    pick = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = numbered.groupBy(F.floor(F.col("line") / 4).alias("record")).agg(pick(0).alias("name"), pick(1).alias("seq"), pick(3).alias("qual"))
    return rows.withColumn("name", F.regexp_replace("name", "^@", ""))


def zipped_fastq(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two files side by side; names up to the first space must be equal, and so must counts."""
    a, b = (df.select("record", *[F.col(c).alias(f"{c}_{k}") for c in ("name", "seq", "qual")]) for k, df in ((1, first), (2, second)))
    both = a.join(b, "record", "full")
    short = lambda c: F.substring_index(c, " ", 1)
    same = F.col("name_1").isNotNull() & F.col("name_2").isNotNull() & (short("name_1") == short("name_2"))
    return both.withColumn("name_1", F.when(same, F.col("name_1")).otherwise(F.raise_error(F.concat(F.lit("records differ at "), F.col("record").cast("string"))).cast("string")))


def gene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a refFlat table; see `gene_annotation_rows`."""
    return gene_annotation_rows(spark.read.text(path))


def gene_annotation_rows(text: DataFrame) -> DataFrame:
    """(name, gene, contig, start, end, negative, coding_start, coding_end, exon_starts, exon_ends) of refFlat lines (value).

    Places are 0-based; `end` is the last one, coding and exon ends are the first place behind.
    """
    parts = F.split("value", "\t")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    return text.select(
        F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(0)).alias("gene"), F.get(parts, F.lit(2)).alias("contig"), F.get(parts, F.lit(4)).cast("long").alias("start"), (F.get(parts, F.lit(5)).cast("long") - 1).alias("end"),
        (F.get(parts, F.lit(3)) == "-").alias("negative"), F.get(parts, F.lit(6)).cast("long").alias("coding_start"), F.get(parts, F.lit(7)).cast("long").alias("coding_end"), numbers(F.get(parts, F.lit(9))).alias("exon_starts"), numbers(F.get(parts, F.lit(10))).alias("exon_ends"),
    )


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="family string, individual string, father string, mother string, sex int, phenotype string")
