"""Filters over reads, mates, and joins between reads, samples and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..params import Params

PAIRED, UNMAPPED, MATE_UNMAPPED, NEGATIVE, MATE_NEGATIVE, FIRST, SECONDARY, SUPPLEMENTARY = 1, 4, 8, 16, 32, 64, 256, 2048


def flagged(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bit)) != 0


def filters(params: Params = Params()) -> dict[str, Column]:
    """Row filters by name; each is true for the reads that stay."""
    size = F.abs("insert_size")
    const = S.mismatches(F.col("const_bc"), F.lit(params.constantBarcode), len(params.constantBarcode), params.acceptNInBarCode)
    excluded = [w.lower() for w in params.contigExcludePattern.split(",") if w]
    contig = F.lower("contig")
    unwanted = F.lit(False)
    for word in excluded:
        unwanted = unwanted | F.contains(contig, F.lit(word))
    return {
        "F01_paired": flagged(PAIRED),
        "F02_mapped": ~flagged(UNMAPPED),
        "F03_primary": ~flagged(SECONDARY),
        "F04_mapping_quality": F.col("mapq") >= params.minMappingQualityQ1,
        "F05_insert_range": size.between(params.minInsertSize, params.maxInsertSize),
        "F06_orientation": ~F.col("orientation").isin("TANDEM", "RF"),
        "F07_constant_barcode": const <= params.nConstantBarcodeMismatchesAllowed,
        "F08_median_phred": F.col("median_phred") >= params.minReadMedianPhredScore,
        "F09_nonzero_insert": F.col("insert_size") != 0,
        "F14_contig": ~unwanted,
        "F21_q2_read": ~F.col("wrong_pair")
        & (F.col("n_clipped") <= params.maxAverageBasesClipped)
        & (F.col("mapq") >= params.minMappingQualityQ2)
        & (size <= params.maxInsertSize),
        "F22_mate_mapped": ~flagged(MATE_UNMAPPED),
        "F25_odd_pair": F.col("wrong_pair") | (size > 1000) | (F.col("contig") != F.col("mate_contig")),
        "F26_insert_sample": (F.col("insert_size") != 0) & (F.col("mapq") >= params.minMappingQualityQ2) & (size < params.maxInsertSize),
    }


def base_filters(params: Params = Params()) -> dict[str, Column]:
    """Filters over single bases; read_place counts from 0 in read order."""
    return {
        "F10_base_phred": F.col("phred") >= params.minBasePhredScoreQ1,
        "F11_ligation": F.col("lig_dist") >= params.ignoreFirstNBasesQ1,
        "F12_read_end": F.col("read_place") < F.col("read_length") - params.ignoreLastNBases,
        "F24_inside_contig": F.col("pos") < F.col("contig_length"),
    }


def filter_ledger(reads: DataFrame, named: dict[str, Column]) -> DataFrame:
    """How many reads each filter drops by itself, in one pass."""
    counts = reads.agg(F.count("*").alias("n"), *[F.count_if(~p).alias(n) for n, p in named.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("dropped")) for n in named])).alias("r")).select("r.*")


def drop_pairs(reads: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Drops a share of pairs; mates share a name, hence the decision."""
    return reads.where(S.drawn(seed, F.col("qname")) >= int(share * 1_000_000))


def random_mate_order(reads: DataFrame, seed: int = 0) -> DataFrame:
    """First and second of a pair exchanged for half of the names."""
    swap = S.drawn(seed, F.col("qname")) % 2 == 1
    return reads.withColumn("flag", F.when(swap & flagged(PAIRED), F.col("flag").bitwiseXOR(F.lit(192))).otherwise(F.col("flag")))


def one_per_key(reads: DataFrame, key: list[str], on_duplicate: str = "keep_best") -> DataFrame:
    """One read a key: that of best mapping quality, or an error at the first duplicate."""
    order = Window.partitionBy(*key).orderBy(F.desc("mapq"), "start", "cigar")
    rows = reads.withColumn("__row", F.row_number().over(order))
    if on_duplicate == "fail":
        error = F.raise_error(F.concat_ws(" ", F.lit("duplicate read"), *[F.col(k).cast("string") for k in key]))
        return rows.where(F.when(F.col("__row") > 1, error.cast("boolean")).otherwise(True)).drop("__row")
    return rows.where("__row = 1").drop("__row")


def seen_often(reads: DataFrame, files: list[tuple[DataFrame, int]], key: list[str], least: int) -> DataFrame:
    """Reads whose key occurs `least` times over the files' reads of each file's mapping quality."""
    every = None
    for other, min_mapq in files:
        rows = other.where(F.col("mapq") >= min_mapq).select(*key)
        every = rows if every is None else every.unionByName(rows)
    often = every.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*key)
    return reads.join(often, key, "left_semi")


def with_mates(reads: DataFrame, key: list[str]) -> DataFrame:
    """Each read with its mate's start, mapping quality and cigar; null without one."""
    own = one_per_key(reads, [*key, "is_first"])
    mates = own.select(*key, (~F.col("is_first")).alias("is_first"), F.col("start").alias("mate_start"), F.col("mapq").alias("mate_mapq"), F.col("cigar").alias("mate_cigar"))
    return own.join(mates, [*key, "is_first"], "left")


def distant_partner(reads: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """Reads with the same name and place in pair elsewhere within `window` of the expected place."""
    right = others.select(F.col("qname"), F.col("is_first"), F.col("start").alias("partner_start"), F.col("cigar").alias("partner_cigar"))
    joined = reads.join(right, ["qname", "is_first"])
    near = (F.col("partner_start") != F.col("start")) & (F.abs(F.col("partner_start") - F.col("mate_start")) <= window)
    return joined.where(near)


def annotate(candidates: DataFrame, listed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates with the listed note, listed rows that no candidate has)."""
    return candidates.join(listed, key, "left"), listed.join(candidates.select(*key).distinct(), key, "left_anti")


def best_sample(reads: DataFrame, samples: DataFrame, length: int, least: int = 9, block: int = 500) -> DataFrame:
    """The sample whose indexes score best for each read, `LOUSY` below `least`.

    Samples are a sample sheet (a few hundred rows); they are taken in blocks of `block` as array
    literals, so scores are made row by row and never as pairs.
    """
    listed = [tuple(r) for r in samples.select("sample", "i7", "i5").orderBy("position").limit(100 * block + 1).collect()]
    if len(listed) > 100 * block:
        raise ValueError("a sample sheet has too many rows")
    best = F.lit(None).cast("struct<score:int,rank:int,sample:string>")
    for a in range(0, len(listed), block):
        scores = [
            F.struct((S.index_score(F.col("i7"), F.lit(i7), length) + S.index_score(F.col("i5"), F.lit(i5), length)).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("sample"))
            for k, (name, i7, i5) in enumerate(listed[a : a + block], a)
        ]
        best = F.greatest(best, F.array_max(F.array(*scores)))
    made = reads.withColumn("__best", best)
    return made.withColumn("sample", F.when(F.col("__best.score") >= least, F.col("__best.sample")).otherwise("LOUSY")).withColumn("score", F.col("__best.score")).drop("__best")


def identical_barcodes(a: DataFrame, b: DataFrame, prefix: int) -> DataFrame:
    """Pairs of reads of two files with one barcode prefix, start and mate start.

    Of the second file only the first read of a barcode counts.
    """
    code = F.substring("barcode", 1, prefix)
    first = Window.partitionBy("code").orderBy("start", "mate_start", "qname")
    right = b.withColumn("code", code).withColumn("r", F.row_number().over(first)).where("r = 1").select("code", "start", "mate_start", F.col("qname").alias("other"))
    return a.withColumn("code", code).join(right, ["code", "start", "mate_start"]).select("qname", "other", "code", "start", "mate_start")


def random_positions(contigs: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """About `rate` of all positions of contigs (contig, length), the same ones for a seed."""
    each = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("pos"))
    return each.where(S.drawn(seed, F.col("contig"), F.col("pos")) < int(rate * 1_000_000))
