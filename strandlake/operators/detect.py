"""From aligned reads to calls: pairs, molecules, bases, strand consensus, quality, disagreements, calls.

`reads` are those of `readers.derived` with a `sample` column. Every step groups or joins by keys that
hold the sample and the contig, so samples and contigs run side by side; reads are expanded to bases
inside the aggregation that reduces them to strands, and only strands are kept for the later steps.

Every parameter has its part in this, but for those of `APART`: to change one of these is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import lattice
from ..functions import sequence as S
from ..params import Params
from ..session import cut
from ..sources import sinks
from . import calls, consensus, molecules, pileup, reads


#: Parameters of chunks and of a check that have no part here.
APART = ("processingChunk", "requireMatchInAlignmentEnd")
EVERYTHING = Params().nRecordsToProcess


def checked(params: Params) -> Params:
    changed = [name for name, _ in params.changed() if name in APART]
    if changed:
        raise ValueError(f"{', '.join(changed)} can't be changed: detection does not use it")
    return params.validated()


@dataclass(frozen=True)
class Detection:
    molecules: DataFrame  #: graded molecules at each place that they cover
    support: DataFrame  #: molecules by level for each allele
    disagreements: DataFrame
    calls: DataFrame  #: mutant alleles with the flags that decide about them

    bases: DataFrame  #: alleles that reads show at places
    params: Params = Params()

    def details(self) -> DataFrame:
        """The table with all measurements and flags of each call."""
        return sinks.detection_details(calls.detailed(self.calls, self.bases, self.molecules, self.params))

    def table(self) -> DataFrame:
        return sinks.detection_rows(self.calls)

    def by_bin(self) -> DataFrame:
        """Unique calls and good molecules of each sample by stretches of a contig."""
        bin_ = F.expr(f"pos div {self.params.contigStatsBinLength}").alias("bin")
        good = self.support.groupBy("sample", "contig", bin_).agg(F.sum("n_good").alias("n_good"))
        unique = self.calls.where("unique_mutation").groupBy("sample", "contig", bin_).agg(F.count("*").alias("n_calls"))
        return good.join(unique, ["sample", "contig", "bin"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def pairs(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Reads of pairs on one contig with what the pair tells: ends of the molecule, strand, barcodes, and the mate.

    Pairs whose reads don't face each other are wrong pairs. A name that more than two primary reads of a
    sample have is an error.
    """
    if params.nRecordsToProcess != EVERYTHING:
        rows = rows.limit(min(params.nRecordsToProcess, 2**31 - 1))
    if params.dropReadProbability:
        rows = reads.drop_pairs(rows, params.dropReadProbability)
    if params.ignoreZeroInsertSizeReads:
        rows = rows.where("tlen <> 0")
    whole = lambda k: S.name_barcode(F.col("qname"), k)
    own = F.coalesce(F.when(F.col("is_first"), whole(1)).otherwise(whole(2)), F.lit(""))
    rows = rows.withColumn("const_bc", F.substring(own, params.variableBarcodeLength + 1, len(params.constantBarcode)))
    named = reads.filters(params)
    single = rows.where(named["F01_paired"] & named["F02_mapped"] & named["F03_primary"] & named["F22_mate_mapped"] & ~reads.flagged(reads.SUPPLEMENTARY))
    single = single.where(named["F04_mapping_quality"] & named["F07_constant_barcode"] & named["F08_median_phred"] & named["F14_contig"])
    pair = Window.partitionBy("sample", "qname")
    both = single.withColumns(
        {
            "n_pair": F.count("*").over(pair),
            "one_contig": F.min("contig").over(pair) == F.max("contig").over(pair),
            "left_start": F.min("unclipped_start").over(pair),
            "right_end": F.max("unclipped_end").over(pair),
            "first_negative": F.max(F.when(F.col("is_first"), F.col("negative"))).over(pair),
            "second_negative": F.max(F.when(~F.col("is_first"), F.col("negative"))).over(pair),
            "mate_mapq": F.sum("mapq").over(pair).cast("int") - F.col("mapq"),
            "mate_five_prime": F.sum("five_prime").over(pair).cast("int") - F.col("five_prime"),
        }
    )
    mate_negative = F.when(F.col("is_first"), F.col("second_negative")).otherwise(F.col("first_negative"))
    often = F.raise_error(F.concat(F.lit("more than two reads of a sample are named "), F.col("qname"))).cast("boolean")
    facing = C.pair_orientation(F.col("negative"), mate_negative, F.col("five_prime"), F.col("mate_five_prime")) == "FR"
    proper = F.when(F.col("n_pair") > 2, often).otherwise((F.col("n_pair") == 2) & F.col("one_contig"))
    if params.ignoreTandemRFPairs:
        proper = proper & facing
    size = F.col("right_end") - F.col("left_start") + 1
    if params.ignoreSizeOutOfRangeInserts:
        proper = proper & size.between(params.minInsertSize, params.maxInsertSize)
    top = ~F.col("first_negative")
    code = lambda k: F.coalesce(F.substring(S.name_barcode(F.col("qname"), k), 1, params.variableBarcodeLength), F.lit(""))
    return both.where(proper).withColumns(
        {
            "strand": F.when(top, "F").otherwise("O"),
            "left_bc": F.when(top, code(1)).otherwise(code(2)),
            "right_bc": F.when(top, code(2)).otherwise(code(1)),
            "insert_size": size,
            "wrong_pair": ~F.coalesce(facing, F.lit(False)),
            "n_clipped": C.clipped_bases(F.col("cigar"), F.col("start"), F.col("negative"), F.when(F.col("negative"), F.col("left_start")).otherwise(F.col("right_end"))),
        }
    )


def in_molecules(paired: DataFrame, params: Params = Params()) -> DataFrame:
    """Reads with `dup`, their molecule: equal ends and barcodes, or those merged into it within the tolerances."""
    keyed = molecules.exact_groups(paired)
    made = keyed.groupBy(F.col("molecule_key").alias("molecule"), *molecules.KEY).agg(
        F.count_if(F.col("strand") == "F").alias("n_top"), F.count_if(F.col("strand") != "F").alias("n_bottom")
    )
    # reads of one name share a molecule whatever their own ends
    first = made.groupBy("molecule").agg(F.min_by(F.struct(*[c for c in made.columns if c != "molecule"]), F.struct(-F.col("n_top") - F.col("n_bottom"), *molecules.KEY)).alias("m"))
    made = first.select("molecule", "m.*")
    merged = molecules.fuzzy_merge(made, params.alignmentPositionMismatchAllowed, params.nVariableBarcodeMismatchesAllowed, ["sample", "contig"])
    found = keyed.join(merged.select(F.col("molecule").alias("molecule_key"), F.col("merged_into").alias("dup")), "molecule_key")
    return without_optical_duplicates(found, params) if params.filterOpticalDuplicates else found


def without_optical_duplicates(grouped: DataFrame, params: Params) -> DataFrame:
    """Of reads of one molecule and end whose spots on a tile lie close in a chain, only the best stays."""
    rows = grouped.withColumns(
        {
            "read_id": F.xxhash64("sample", "qname", "is_first", "flag", "start"),
            "run_tile": S.run_tile(F.col("qname")),
            "x": S.tile_coordinate(F.col("qname"), 6),
            "y": S.tile_coordinate(F.col("qname"), 7),
            "avg_phred": F.col("mean_phred"),
        }
    )
    marked = molecules.optical_duplicates(cut(rows), params.opticalDuplicateDistance, ["sample", "dup", "is_first", "negative"])
    return marked.where("NOT optical_duplicate").select(*grouped.columns)


MOLECULE_KEY = ["sample", "contig", "dup"]


def traits(grouped: DataFrame) -> DataFrame:
    """What the reads of each molecule have in common: clipping, mapping quality, inserts, wrong pairs."""
    return grouped.groupBy(*MOLECULE_KEY).agg(
        F.floor(F.sum("n_clipped") / F.count("*")).cast("long").alias("avg_clipped"),
        F.max(F.least("mapq", "mate_mapq")).alias("mapping_quality"),
        F.min("insert_size").alias("min_insert"),
        F.max("insert_size").alias("max_insert"),
        F.max("wrong_pair").alias("has_wrong_pair"),
    )


def trait_assays(params: Params) -> dict[str, Column]:
    """Assays of whole molecules; one that fails leaves them dubious."""
    return {
        "AVERAGE_N_CLIPPED": lattice.graded(F.col("avg_clipped") <= params.maxAverageBasesClipped, F.lit(True)),
        "MAPPING_QUALITY": lattice.graded(F.col("mapping_quality") >= params.minMappingQualityQ2, F.lit(True)),
        "INSERT_SIZE": lattice.graded((F.col("min_insert") >= params.minInsertSize) & (F.col("max_insert") <= params.maxInsertSize), F.lit(True)),
        "CLOSE_PAIR": lattice.graded(~F.col("has_wrong_pair"), F.lit(True)),
    }


def capped(graded: DataFrame, shown: DataFrame, params: Params) -> DataFrame:
    """Molecules at places, and of alleles, that are not trusted are dubious at best.

    A place: by the median phred of its bases, the share of wrong pairs, and the mean clipping of the molecules
    over it. An allele: by the median phred of its bases. What no parameter asks for is not computed.
    """
    allele = F.coalesce("top_allele", "bottom_allele")
    doubts = []
    if params.minMedianPhredScoreAtPosition > 0 or params.maxFractionWrongPairsAtPosition < 1:
        here = calls.position_statistics(shown)
        doubts.append((here.where((F.col("median_phred") < params.minMedianPhredScoreAtPosition) | (F.col("wrong_pairs") > params.maxFractionWrongPairsAtPosition)), False))
    if params.maxAverageClippingOfAllCoveringDuplexes < Params().maxAverageClippingOfAllCoveringDuplexes:
        covering = graded.groupBy(*consensus.LOCATION).agg(F.avg("avg_clipped").alias("clipping"))
        doubts.append((covering.where(F.col("clipping") > params.maxAverageClippingOfAllCoveringDuplexes), False))
    if params.minCandidateMedianPhredScore > params.minBasePhredScoreQ1:  # all bases have the second one
        phred = shown.groupBy(*consensus.LOCATION, "allele").agg(calls.element("phred", 0.5).alias("median_phred"))
        doubts.append((phred.where(F.col("median_phred") < params.minCandidateMedianPhredScore), True))
    rows = graded.withColumn("allele", allele)
    for doubt, by_allele in doubts:
        key = [*consensus.LOCATION, *(["allele"] if by_allele else [])]
        rows = rows.join(doubt.select(*key).withColumn("__doubt", F.lit(lattice.DUBIOUS)), key, "left")
        rows = rows.withColumn("quality", F.least("quality", "__doubt")).drop("__doubt")
    return rows.drop("allele")


def capped_support(support: DataFrame, params: Params) -> DataFrame:
    """Support without good molecules at places whose top frequency is out of range."""
    if params.minTopAlleleFreqQ2 <= 0 and params.maxTopAlleleFreqQ2 >= 1:
        return support
    rows = calls.capped_by_top_frequency(calls.totals(support).withColumn("quality", F.lit(lattice.GOOD)), params)
    return rows.withColumn("n_good", F.when(F.col("quality") >= lattice.GOOD, F.col("n_good")).otherwise(F.lit(0).cast("long"))).select(*support.columns)


def bases(grouped: DataFrame, reference: DataFrame, params: Params = Params(), size: int = pileup.CHUNK, overlap: int = pileup.OVERLAP) -> DataFrame:
    """Alleles that reads show at places, as `consensus` takes them. reference: chunks with `overlap`."""
    keep = ["sample", "dup", "strand", "mapq", "mate_mapq", "insert_size", "five_prime", "mate_five_prime", "left_start", "right_end", "wrong_pair"]
    seen = pileup.observed(grouped, keep, reference, params.ignoreLastNBases, size, overlap).where("NOT hidden AND kind <> 'INTRON'")
    marked = F.when(F.col("kind") == "INSERTION", F.concat(F.lit("^"), "seq", F.lit("^"))).when(F.col("kind") == "DELETION", F.concat(F.lit("-"), "seq", F.lit("-")))
    distance = F.least(F.abs(F.col("pos") - F.col("five_prime")), F.abs(F.col("mate_five_prime") - F.col("pos")))
    rows = seen.withColumns({"allele": F.coalesce(marked, "seq"), "lig_dist": distance})
    good = F.col("phred").isNull() | (F.col("phred") >= params.minBasePhredScoreQ1)
    return rows.where(good & (F.col("lig_dist") > params.ignoreFirstNBasesQ1))


def with_wildtype(rows: DataFrame, reference: DataFrame, size: int = pileup.CHUNK) -> DataFrame:
    """Rows of places with the wildtype allele: the reference letter, or nothing at half places."""
    return pileup.with_reference(rows, reference, size).withColumn("wt", F.when(F.col("half"), "").otherwise(F.col("wt")))


def detect(rows: DataFrame, reference: DataFrame, params: Params = Params(), size: int = pileup.CHUNK, overlap: int = pileup.OVERLAP) -> Detection:
    """Molecules, support, disagreements and calls of reads, over all samples and contigs at once."""
    checked(params)
    grouped = in_molecules(pairs(rows, params), params)
    shown = bases(grouped, reference, params, size, overlap)
    strands = cut(consensus.strand_consensus(consensus.allele_counts(shown, params.minBasePhredScoreQ1, params.minBasePhredScoreQ2)))
    known = consensus.molecules(strands).join(traits(grouped), MOLECULE_KEY)
    graded = capped(consensus.grade(known, params, trait_assays(params)), shown, params)
    support = with_wildtype(capped_support(consensus.graded_support(graded), params), reference, size)
    apart = consensus.disagreeing(with_wildtype(consensus.molecules(strands), reference, size), F.col("wt"), params)
    if params.maxMutFreqForDisag < 1:
        apart = calls.capped_disagreements(apart, calls.totals(support), params)
    found = calls.unique_calls(support, F.col("wt"), apart, params)
    return Detection(graded, support, apart, found, shown, params)
