"""Queries of file formats: lines made from the stand-in views, read by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import intervals, molecules, reads, stats
from ..operators.calls import element
from ..operators.order import numbered
from ..params import Params
from ..session import shared_folder, table
from ..sources import arrays, bam, readers, sinks
from ..standins import view
from .registry import query


@query("S03_sam_text", "SELECT qname, flag, contig, start, mapq, cigar, mate_contig, mate_start, insert_size AS tlen, seq, qual, line::VARCHAR AS dq FROM reads_v")
def s03(spark, sf):
    rows = view(spark, sf, "reads_v").withColumns({"tlen": F.col("insert_size"), "tags": F.create_map(F.lit("DQ"), F.col("line").cast("string"))})
    made = readers.sam_rows(sinks.sam_lines(rows))
    return made.select(*readers.SAM_FIELDS, F.col("tags")["DQ"].alias("dq"))


CONTIGS = ("chrA", "chrM", "chrN", "chrR", "chrUn_7")


def new_folder(spark, name):
    """A folder that all executors share, for files that a query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bam_files(spark, sf, indexed=True):
    """The stand-in reads as sorted binary files with their indexes; order and line are tags."""
    rows = view(spark, sf, "reads_v")
    tags = F.create_map(F.lit("OI"), F.col("order_id").cast("string"), F.lit("LN"), F.col("line").cast("string"), F.lit("DQ"), F.col("line").cast("string"))
    longest = rows.agg(F.max(F.greatest("start", "mate_start"))).first()[0] or 0
    folder = new_folder(spark, "bam")
    bam.write_sorted(rows.withColumns({"tlen": F.col("insert_size"), "tags": tags}), folder, [(c, longest + 1000) for c in CONTIGS], {"OI": "i", "LN": "i"})
    if indexed:
        bam.write_indexes(spark, folder).write.format("noop").mode("overwrite").save()
    return folder


ORDER_AND_LINE = ["CAST(tags.OI AS BIGINT) AS order_id", "CAST(tags.LN AS INT) AS line"]
_REF_END_SQL = "start + greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '\\d+[MDN]'), lambda e: regexp_extract(e, '\\d+')::INT)), 0))::INT - 1"


@query("K09_bam_round_trip", "SELECT qname, flag, contig, start, mapq, cigar, mate_contig, mate_start, insert_size AS tlen, seq, qual, line::VARCHAR AS dq FROM reads_v")
def k09_bam(spark, sf):
    """Reads written as binary files by the sink, and read again from there."""
    return bam.read(spark, bam_files(spark, sf, indexed=False)).select(*readers.SAM_FIELDS, F.col("tags")["DQ"].alias("dq"))


@query("S01_range_scan", f"SELECT order_id, line FROM reads_v WHERE contig = 'chrN' AND start <= 90 AND {_REF_END_SQL} >= 50 - 20 + 1")
def s01(spark, sf):
    return bam.over_range(spark, bam_files(spark, sf), "chrN", 50 - 20 + 1, 90).selectExpr(*ORDER_AND_LINE)


@query("S02_full_scan", "SELECT contig, count(*) AS n, max(start)::INT AS last FROM reads_v GROUP BY ALL")
def s02(spark, sf):
    return bam.read(spark, bam_files(spark, sf, indexed=False)).groupBy("contig").agg(F.count("*").alias("n"), F.max("start").alias("last"))


_AT_PLACE = "contig = 'chrN' AND start = (SELECT min(start) FROM reads_v WHERE contig = 'chrN') AND flag & 64 = 64"


@query("S04_point_lookup", f"SELECT order_id, line, start FROM reads_v WHERE {_AT_PLACE} AND qname = (SELECT max(qname) FROM reads_v WHERE {_AT_PLACE})")
def s04(spark, sf):
    """One read by name, end and place, from the index; its name is the last one at the contig's first place."""
    folder = bam_files(spark, sf)
    start = view(spark, sf, "reads_v").where("contig = 'chrN'").agg(F.min("start")).first()[0] or 0
    here = bam.at_place(spark, folder, "chrN", start).where(reads.flagged(64))
    name = here.agg(F.max("qname")).first()[0]
    return here.where(F.col("qname") == name).selectExpr(*ORDER_AND_LINE, "start")


@query("V20_index_bins", """WITH r AS (SELECT contig, start AS a, """ + _REF_END_SQL + """ AS z FROM reads_v),
b AS (SELECT contig, CASE WHEN a >> 14 = z >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = z >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = z >> 20 THEN 73 + (a >> 20) WHEN a >> 23 = z >> 23 THEN 9 + (a >> 23) WHEN a >> 26 = z >> 26 THEN 1 + (a >> 26) ELSE 0 END AS bin FROM r)
SELECT DISTINCT contig, 'bin' AS kind, bin::INT AS number FROM b UNION ALL
SELECT DISTINCT contig, 'window', w::INT FROM (SELECT contig, unnest(range(0, max(z >> 14) + 1)) AS w FROM r GROUP BY contig)""")
def v20_bins(spark, sf):
    """Bins and windows of the indexes beside the files, over all files of a contig."""
    bam.register(spark)
    rows = spark.read.format("bai").load(bam_files(spark, sf)).where("kind IN ('chunk', 'window')")
    return rows.select("contig", F.when(F.col("kind") == "chunk", "bin").otherwise("window").alias("kind"), F.col("bin").alias("number")).distinct()


@query("S06_bed", "SELECT name, contig, start, \"end\", score::DOUBLE AS score, negative FROM features_v")
def s06(spark, sf):
    f = view(spark, sf, "features_v")
    strand = F.when(F.col("negative").isNull(), ".").when(F.col("negative"), "-").otherwise("+")
    fields = [F.col("contig"), (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string"), F.col("name"), F.col("score").cast("string"), strand]
    return readers.bed_rows(f.select(F.concat_ws("\t", *fields).alias("value")))


@query("S07_name_map", "SELECT p_brand AS id, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY p_brand")
def s07(spark, sf):
    lines = table(spark, sf, "part").select(F.concat_ws("\t", "p_brand", "p_type").alias("value"))
    return readers.name_map_rows(lines).select("id", "names")


@query("S08_mutation_list", "SELECT sample, 'chr' || pos % 20 AS contig, pos, CASE dup WHEN 0 THEN 'SUBSTITUTION' WHEN 1 THEN 'DELETION' ELSE 'INSERTION' END AS kind, CASE dup WHEN 0 THEN 'T' ELSE 'ACG' END AS sequence FROM bases_v")
def s08(spark, sf):
    b = view(spark, sf, "bases_v")
    change = F.when(F.col("dup") == 0, "AT").when(F.col("dup") == 1, "-ACG-").otherwise("^ACG^")
    lines = b.select(F.concat_ws("\t", "sample", (F.col("pos") % 20).cast("string"), (F.col("pos") + 1).cast("string"), change).alias("value"))
    return readers.mutation_rows(lines).select("sample", "contig", "pos", "kind", "sequence")


@query("S09_position_lists", "SELECT contig, unnest(range(start, \"end\" + 1)) AS pos, false AS half FROM features_v UNION ALL SELECT contig, start, true FROM features_v")
def s09(spark, sf):
    f = view(spark, sf, "features_v")
    first, last = F.format_number(F.col("start") + 1, 0), F.format_number(F.col("end") + 1, 0)
    span = F.concat("contig", F.lit(":"), first, F.lit("-"), last)
    point = F.concat("contig", F.lit(":"), first, F.lit(".5"))
    return readers.position_rows(f.select(F.concat_ws("  ", span, point).alias("value")))


_DENSE_SQL = "m AS (SELECT contig, max(pos) AS last FROM coverage_v GROUP BY contig), p AS (SELECT contig, unnest(range(0, last + 1)) AS pos FROM m), d AS (SELECT p.contig, p.pos, coalesce(value, 0)::BIGINT AS value FROM p LEFT JOIN coverage_v c ON p.contig = c.contig AND p.pos = c.pos)"


def position_files(spark, sf):
    """The stand-in coverage as files of packed numbers."""
    folder = new_folder(spark, "numbers")
    arrays.write(arrays.packed(view(spark, sf, "coverage_v")), folder, sample="s")
    return arrays.read(spark, folder)


@query("S11_position_arrays", "SELECT contig, count(*) AS n, sum(value)::BIGINT AS total FROM coverage_v GROUP BY ALL")
def s11(spark, sf):
    """From packed files: places with a value, and the sum over all."""
    return position_files(spark, sf).where("value <> 0").groupBy("contig").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("S11_position_values", f"WITH {_DENSE_SQL} SELECT 's' AS sample, * FROM d")
def s11_values(spark, sf):
    """Every position of every contig, from packed files."""
    return position_files(spark, sf)


@query("K05_coverage_arrays", f"""WITH {_DENSE_SQL}
SELECT contig, pos // 65536 AS chunk, count(*) AS size, sha256(string_agg(CASE WHEN value < 128 THEN printf('%02X', value) WHEN value < 16384 THEN printf('%02X%02X', value & 127 | 128, value >> 7) ELSE printf('%02X%02X%02X', value & 127 | 128, (value >> 7) & 127 | 128, value >> 14) END, '' ORDER BY pos)) AS packed_sha256
FROM d GROUP BY contig, chunk""")
def k05(spark, sf):
    """Packed chunks, with the digest of their bytes in hexadecimal."""
    return arrays.packed(view(spark, sf, "coverage_v")).select("contig", "chunk", "size", F.sha2(F.hex("numbers"), 256).alias("packed_sha256"))


@query("K10_annotated_list", "WITH l AS (SELECT p_partkey * 2 AS pos, p_brand AS note FROM part) SELECT l.pos, note, CASE WHEN c.pos IS NULL THEN 'NOT FOUND' ELSE 'FOUND' END AS outcome FROM l LEFT JOIN (SELECT DISTINCT pos FROM coverage_v WHERE value > 8) c ON l.pos = c.pos")
def k10(spark, sf):
    listed = table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("pos"), F.col("p_brand").alias("note"))
    return sinks.annotated_list(listed, view(spark, sf, "coverage_v").where("value > 8").select("pos").distinct(), ["pos"])


@query("K13_counter_lines", "SELECT contig || ': ' || format('{:,}', sum(value)::BIGINT) AS value FROM coverage_v GROUP BY contig")
def k13(spark, sf):
    counters = view(spark, sf, "coverage_v").groupBy(F.col("contig").alias("name")).agg(F.sum("value").alias("total")).withColumn("level", F.lit(1))
    return sinks.counters_text(counters, 2)


@query("K14_transcript_coverage", """WITH r AS (SELECT f.name, c.value FROM coverage_v c JOIN features_v f ON f.contig = c.contig AND c.pos BETWEEN f.start AND f."end")
SELECT name, round(max(value) / avg(value), 6) AS top_over_mean FROM r GROUP BY name""")
def k14(spark, sf):
    rows = intervals.normalised_coverage(view(spark, sf, "coverage_v"), view(spark, sf, "features_v"))
    return rows.groupBy("name").agg(F.max("over_mean").alias("top_over_mean"))


@query("K15_fastq_by_sample", "SELECT contig AS sample, count(*) AS n, min('@' || qname || chr(10) || seq || chr(10) || '+' || chr(10) || qual) AS first_record FROM reads_v GROUP BY contig")
def k15(spark, sf):
    rows = view(spark, sf, "reads_v").select(F.col("contig").alias("sample"), F.concat(F.lit("@"), "qname", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.min("value").alias("first_record"))


@query("K16_threshold_bed", """WITH k AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM coverage_v WHERE value >= 12)
SELECT contig || chr(9) || min(pos) || chr(9) || max(pos) AS value FROM k GROUP BY contig, g""")
def k16(spark, sf):
    runs = intervals.threshold_runs(view(spark, sf, "coverage_v"), 12)
    return runs.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))


@query("F27_change_length", "SELECT order_id, line, length(regexp_replace(seq, '[AC]', '', 'g')) AS n FROM reads_v WHERE length(regexp_replace(seq, '[AC]', '', 'g')) BETWEEN 10 AND 15")
def f27(spark, sf):
    n = F.length(F.regexp_replace("seq", "[AC]", ""))
    return view(spark, sf, "reads_v").where(n.between(10, 15)).select("order_id", "line", n.alias("n"))


@query("F28_region_predicates", """SELECT 'IN' AS predicate, count(*) AS total FROM coverage_v c WHERE EXISTS (SELECT 1 FROM features_v f WHERE f.contig = c.contig AND c.pos BETWEEN f.start AND f."end" AND score > 45)
UNION ALL SELECT 'OUT', count(*) FROM coverage_v c WHERE NOT EXISTS (SELECT 1 FROM features_v f WHERE f.contig = c.contig AND c.pos BETWEEN f.start AND f."end" AND score > 45)""")
def f28(spark, sf):
    rows, features = view(spark, sf, "coverage_v"), view(spark, sf, "features_v").where("score > 45")
    hits = intervals.inside(rows.select("contig", "pos"), features).withColumn("hit", F.lit(True))
    marked = rows.join(hits, ["contig", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return stats.by_predicate(marked, {"IN": F.col("hit"), "OUT": ~F.col("hit")}, F.lit(1))


@query("X19_mutation_order", "SELECT DISTINCT allele, dup, rank() OVER (ORDER BY dup, allele) AS place FROM (SELECT DISTINCT allele, dup FROM bases_v)")
def x19(spark, sf):
    rows = view(spark, sf, "bases_v").select("allele", "dup").distinct()
    return rows.withColumn("place", F.rank().over(Window.orderBy("dup", "allele")).cast("long"))


@query("X34_repeated_names", "SELECT qname, count(*) AS n FROM reads_v GROUP BY ALL HAVING count(*) > 1")
def x34(spark, sf):
    return view(spark, sf, "reads_v").groupBy("qname").agg(F.count("*").alias("n")).where("n > 1")


def _letters_differ(column):
    return " + ".join(f"CASE WHEN a.{column}[{k}] <> b.{column}[{k}] AND a.{column}[{k}] <> 'N' AND b.{column}[{k}] <> 'N' THEN 1 ELSE 0 END" for k in (1, 2, 3))


@query("J14_compatible_molecules", f"""WITH m AS (SELECT DISTINCT sample, contig, left_start, right_end, left_bc, right_bc FROM molecules_v), d AS (SELECT unnest(range(-2, 3)) AS d)
SELECT a.sample, a.contig, a.left_start, a.right_end, a.left_bc, a.right_bc, count(*) AS n FROM m a, d JOIN m b ON a.sample = b.sample AND a.contig = b.contig AND b.left_start = a.left_start + d
WHERE abs(a.right_end - b.right_end) <= 2 AND {_letters_differ("left_bc")} <= 1 AND {_letters_differ("right_bc")} <= 1 GROUP BY ALL""")
def j14(spark, sf):
    """How many molecules each one is compatible with, itself included, by both ends and both barcodes."""
    fields = ["sample", "contig", "left_start", "right_end", "left_bc", "right_bc"]
    rows = view(spark, sf, "molecules_v").select(*fields).distinct().withColumn("molecule", F.concat_ws("/", *fields))
    pairs = molecules.compatible_molecules(rows, 2, 1, ["sample", "contig"])
    counts = pairs.select(F.explode(F.array("a", "b")).alias("molecule")).groupBy("molecule").agg(F.count("*").alias("others"))
    return rows.join(counts, "molecule", "left").select(*fields, (F.coalesce("others", F.lit(0)) + 1).alias("n"))


@query("J19_zipped_records", "SELECT order_id, line, min(start) AS start, min(mate_start) AS mate_start FROM reads_v GROUP BY ALL")
def j19(spark, sf):
    """Two files of records, one for each order and line, with the start of the read in one and of its mate in the other."""
    rows = view(spark, sf, "reads_v").groupBy("order_id", "line").agg(F.min("start").alias("start"), F.min("mate_start").alias("mate_start"), F.min("qual").alias("qual"))
    record = F.col("order_id") * 10 + F.col("line")
    file = lambda c: rows.select(record.alias("record"), F.concat(record.cast("string"), F.lit(" "), F.col(c).cast("string")).alias("name"), F.col(c).cast("string").alias("seq"), "qual")
    both = readers.zipped_fastq(file("start"), file("mate_start"))
    return both.select(F.floor(F.col("record") / 10).alias("order_id"), (F.col("record") % 10).cast("int").alias("line"), F.col("seq_1").cast("int").alias("start"), F.col("seq_2").cast("int").alias("mate_start"))


@query("O02_molecule_sort", "SELECT molecule, n_top, n_bottom, left_start, row_number() OVER (ORDER BY n_top + n_bottom DESC, least(n_top, n_bottom) DESC, left_start, right_end, left_bc, right_bc, molecule, insert_size, n_top) AS place FROM molecules_v")
def o02(spark, sf):
    order = [F.desc(F.col("n_top") + F.col("n_bottom")), F.desc(F.least("n_top", "n_bottom")), "left_start", "right_end", "left_bc", "right_bc", "molecule", "insert_size", "n_top"]
    return numbered(view(spark, sf, "molecules_v"), order).select("molecule", "n_top", "n_bottom", "left_start", "place")


@query("O03_sorted_percentiles", "SELECT contig, list_sort(list(value))[floor(count(*) * 0.25)::INT + 1] AS p25, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50 FROM coverage_v GROUP BY contig")
def o03(spark, sf):
    return view(spark, sf, "coverage_v").groupBy("contig").agg(element("value", 0.25).cast("long").alias("p25"), element("value", 0.5).cast("long").alias("p50"))


@query("O04_value_sort", "SELECT contig, pos, value FROM coverage_v ORDER BY value DESC, contig, pos LIMIT 50")
def o04(spark, sf):
    return view(spark, sf, "coverage_v").orderBy(F.desc("value"), "contig", "pos").limit(50)


@query("L01_first_names", "SELECT contig, start, list_sort(list(DISTINCT qname))[1:20] AS names FROM reads_v GROUP BY contig, start")
def l01(spark, sf):
    return stats.first_values(view(spark, sf, "reads_v"), ["contig", "start"], "qname", 20, distinct=True, name="names")


@query("V20_index_statistics", "SELECT contig, count(*) FILTER (flag & 4 = 0) AS aligned, count(*) FILTER (flag & 4 <> 0) AS unaligned FROM reads_v GROUP BY contig")
def v20(spark, sf):
    """From the indexes alone, without reading a record."""
    return bam.index_statistics(spark, bam_files(spark, sf))


@query("V21_quality_range", "SELECT line, min(ascii(q)) AS lowest, max(ascii(q)) AS highest FROM (SELECT line, unnest(string_split(qual, '')) AS q FROM reads_v) GROUP BY line")
def v21(spark, sf):
    each = view(spark, sf, "reads_v").select("line", F.explode(F.split("qual", "")).alias("q"))
    return each.groupBy("line").agg(F.min(F.ascii("q")).alias("lowest"), F.max(F.ascii("q")).alias("highest"))


@query("S05_fasta", "SELECT name AS contig, repeat('ACGN', (score % 5)::INT + 1) AS seq FROM features_v")
def s05(spark, sf):
    f = view(spark, sf, "features_v")
    body = F.regexp_replace(F.repeat(F.lit("acgn"), (F.col("score") % 5 + 1).cast("int")), "(.{6})", "$1\n")
    return readers.fasta_rows(f.select(F.concat("name", F.lit(" text\n"), body, F.lit("\n")).alias("value")))


@query("P06_collectors", "SELECT contig, list_sort(list(DISTINCT value)) AS seen, list_sort(list(value))[1:5] AS lowest FROM coverage_v GROUP BY contig")
def p06(spark, sf):
    rows = view(spark, sf, "coverage_v")
    seen = rows.select("contig", "value").distinct().groupBy("contig").agg(F.array_sort(F.collect_list("value")).alias("seen"))
    return seen.join(stats.first_values(rows, ["contig"], "value", 5, name="lowest"), "contig")


@query("S12_parameters", "SELECT * FROM (VALUES ('alignmentPositionMismatchAllowed', '5'), ('ignoreTandemRFPairs', 'True'), ('maxInsertSize', '2000'), ('minConsensusThresholdQ2', '0.9'), ('minMappingQualityQ1', '30')) v(name, value)")
def s12(spark, sf):
    """Parameters of a command line that differ from their defaults."""
    words = "-minMappingQualityQ1 30 -ignoreTandemRFPairs -maxInsertSize 2000 -minConsensusThresholdQ2 0.9 -alignmentPositionMismatchAllowed 5 -minReadsPerStrandQ2 3"
    return spark.createDataFrame(Params.parse(words.split()).changed(), "name string, value string")


@query("S10_fastq", "SELECT qname || ' ' || line AS name, seq, qual FROM reads_v")
def s10(spark, sf):
    """Reads written as FASTQ text to the shared folder, and read again from there."""
    folder = new_folder(spark, "fastq")
    record = F.concat(F.lit("@"), "qname", F.lit(" "), F.col("line").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    view(spark, sf, "reads_v").select(record.alias("value")).write.text(folder)
    return readers.fastq(spark, folder).select("name", "seq", "qual")
