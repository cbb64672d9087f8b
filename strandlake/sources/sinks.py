"""Outputs: projections to the public table formats, and writers that leave partitioning to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detection_rows(calls: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row for each call and sample with 1-based positions, and columns `more` as they are."""
    return calls.select(
        F.when(F.col("unique_mutation"), "*").otherwise("").alias("flag"),
        F.concat_ws(":", "sample", "contig", F.concat((F.col("pos") + 1).cast("string"), F.when(F.col("half"), ".5").otherwise(""))).alias("place"),
        "sample",
        "contig",
        (F.col("pos") + 1).alias("position"),
        "half",
        "allele",
        "n_good",
        "n_good_dubious",
        "n_all",
        F.round("freq", 6).alias("freq"),
        "sister_coverage",
        *(more or []),
    )


#: What `detection_details` adds to the table, in order.
DETAILS = [
    "n_reads", "median_phred", "place_median_phred", "wrong_pairs", "min_insert", "max_insert", "insert_10", "insert_90", "mean_mapq", "n_far_mates", "n_concurring", "min_distance", "max_distance",
    "total_n_good", "total_n_good_dubious", "total_n_all", "n_samples_with_allele", "some_without_wildtype", "no_wildtype", "present_in_sister", "several_at_position", "enough_molecules", "sister_covered", "coverage_ok", "has_disagreement",
]


def detection_details(detailed: DataFrame) -> DataFrame:
    """The detection table with one column more for each measurement and each flag that decides about a call."""
    return detection_rows(detailed, DETAILS)


def mutation_bed(calls: DataFrame) -> DataFrame:
    return calls.where("unique_mutation").select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"), "allele", "sample")


def disagreement_bed(disagreements: DataFrame, with_wildtype: bool) -> DataFrame:
    chosen = disagreements.where(F.col("has_wt") == with_wildtype)
    return chosen.select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat("fst", F.lit("->"), "snd").alias("change"), "sample")


def coverage_bed(support: DataFrame) -> DataFrame:
    """Molecules over each base; half places are no bases."""
    rows = support.where("NOT half").groupBy("sample", "contig", "pos").agg(F.sum("n_good_dubious").alias("molecules"))
    return rows.where("molecules > 0").select("sample", "contig", F.col("pos").alias("start"), F.col("pos").alias("end"), "molecules")


def json_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """One JSON object for each key with all of its rows' other columns, in order."""
    others = [c for c in rows.columns if c not in key]
    grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*sorted(others)))).alias("candidates"))
    return grouped.select(*key, F.to_json(F.struct("candidates")).alias("json"))


def variants(calls: DataFrame) -> DataFrame:
    """VCF-like rows: REF and ALT by kind, with the samples that have the change."""
    ref = F.when(F.col("kind") == "DELETION", F.concat("wt", "seq")).otherwise(F.col("wt"))
    alt = F.when(F.col("kind") == "DELETION", F.col("wt")).when(F.col("kind") == "INSERTION", F.concat("wt", "seq")).otherwise(F.col("seq"))
    rows = calls.select("contig", (F.col("pos") + 1).alias("pos"), ref.alias("ref"), alt.alias("alt"), "sample")
    return rows.groupBy("contig", "pos", "ref", "alt").agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))


def vcf_text(rows: DataFrame) -> DataFrame:
    """Lines of a VCF body, sorted by range so that each file holds one stretch."""
    ordered = rows.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos")
    return ordered.select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.concat(F.lit("SAMPLES="), "samples")).alias("value"))


def annotated_list(listed: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Listed mutations with what was found, `NOT FOUND` where nothing was."""
    joined = listed.join(found.withColumn("__found", F.lit(True)), key, "left")
    return joined.withColumn("outcome", F.when(F.col("__found"), "FOUND").otherwise("NOT FOUND")).drop("__found")


def annotated_reads(reads: DataFrame, molecules: DataFrame, key: list[str], most_below_q2: int | None = None) -> DataFrame:
    """Reads with their molecule's tags; of molecules below Q2 at most `most_below_q2` a position."""
    if most_below_q2 is not None:
        order = Window.partitionBy("contig", "left_start").orderBy(F.desc("quality"), *key)
        below = F.sum(F.when(F.col("quality") < 2, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        molecules = molecules.withColumn("__below", below).where((F.col("quality") >= 2) | (F.col("__below") <= most_below_q2)).drop("__below")
    return reads.join(molecules.select(*key, F.col("quality").alias("DQ"), F.col("n_reads").alias("DN")), key)


def collapsed(reads: DataFrame, key: list[str]) -> DataFrame:
    """One read for each molecule strand: the best mapped one."""
    order = Window.partitionBy(*key, "strand").orderBy(F.desc("mapq"), "read_id")
    return reads.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def sam_lines(reads: DataFrame) -> DataFrame:
    """SAM text of reads with 0-based positions."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"])), "\t")
    fixed = [F.col(c).cast("string") if c not in ("start", "mate_start") else (F.col(c) + 1).cast("string") for c in ("qname", "flag", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "tlen", "seq", "qual")]
    return reads.select(F.concat_ws("\t", *fixed, F.when(F.size("tags") > 0, tags)).alias("value"))


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_arrays(values: DataFrame, path: str) -> None:
    """Position arrays in long form, a folder a contig."""
    values.write.mode("overwrite").partitionBy("contig").parquet(path)


def write_fastq_by_sample(records: DataFrame, path: str) -> None:
    """FASTQ text split by sample; a hot sample is spread over tasks by record."""
    records.select("sample", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").partitionBy("sample").text(path)


def write_database(rows: DataFrame, url: str, name: str, driver: str, connections: int = 8) -> None:
    rows.coalesce(connections).write.mode("append").option("driver", driver).jdbc(url, name)


def counters_text(counters: DataFrame, verbosity: int) -> DataFrame:
    """Lines of counters up to a level of detail, largest first."""
    return counters.where(F.col("level") <= verbosity).orderBy(F.desc("total"), "name").select(F.concat_ws(": ", "name", F.format_number("total", 0)).alias("value"))
