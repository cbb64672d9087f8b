"""From bases to molecules' strand consensus, their quality, and disagreements between strands.

`bases` has a row for each observed base: sample, contig, pos, half, dup (molecule), strand, allele, phred
and, where asked for, mapq, mate_mapq, lig_dist, left_start and right_end. A place is a position of a
contig or the gap after it (half). An allele is the text of a change, so that its kind is part of it:
letters, `^letters^` for an insertion, `-letters-` for a deletion. Ties are settled by allele. The row
groups shrink at every step: bases are reduced to alleles of a strand, those to strands, those to
molecules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lattice
from ..params import Params

PLACE = ["contig", "pos", "half"]
LOCATION = ["sample", *PLACE]
MOLECULE = [*LOCATION, "dup"]


def kind_of(allele: Column) -> Column:
    return F.when(F.startswith(allele, F.lit("^")), "INSERTION").when(F.startswith(allele, F.lit("-")), "DELETION").otherwise("SUBSTITUTION")


def letters_of(allele: Column) -> Column:
    return F.regexp_replace(allele, r"[\^-]", "")


def allele_counts(bases: DataFrame, min_phred: int = 0, q2_phred: int = 30) -> DataFrame:
    """Reads for each allele of each strand of each molecule, and those of `q2_phred` or more; bases without phred always count."""
    passing = F.col("phred").isNull() | (F.col("phred") >= min_phred)
    return bases.where(passing).groupBy(*MOLECULE, "strand", "allele").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("phred").isNull() | (F.col("phred") >= q2_phred)).alias("n_q2"),
        F.sum("phred").alias("phred_sum"),
        F.max("lig_dist").alias("max_lig"),
    )


def by_molecule(bases: DataFrame) -> DataFrame:
    """Bases dealt out by molecule, so that its alleles, strands and consensus are made by one shuffle and not by three."""
    return bases.repartition(*MOLECULE)


def strand_consensus(counts: DataFrame) -> DataFrame:
    """Most frequent allele of each strand: top, n_top, n_strand, n_q2."""
    best = F.min_by(F.struct("allele", "n", "n_q2"), F.struct(-F.col("n"), F.col("allele")))
    return (
        counts.groupBy(*MOLECULE, "strand")
        .agg(best.alias("b"), F.sum("n").alias("n_strand"), F.max("max_lig").alias("max_lig"))
        .select(*MOLECULE, "strand", F.col("b.allele").alias("top"), F.col("b.n").alias("n_top"), F.col("b.n_q2").alias("n_q2"), "n_strand", "max_lig")
    )


def molecules(strands: DataFrame, first: str = "F", second: str = "O") -> DataFrame:
    """One row a molecule with both strands side by side."""
    side = lambda s, c, a: F.max(F.when(F.col("strand") == s, F.col(c))).alias(a)
    wide = [side(s, c, f"{p}_{c}") for s, p in ((first, "top"), (second, "bottom")) for c in ("top", "n_top", "n_q2", "n_strand", "max_lig")]
    return strands.groupBy(*MOLECULE).agg(*wide).withColumnsRenamed({"top_top": "top_allele", "bottom_top": "bottom_allele"})


def passes(share: float) -> Column:
    """Whether each strand that is there agrees to `share` of its reads."""
    one = lambda p: F.coalesce(F.col(f"{p}_n_top") >= share * F.col(f"{p}_n_strand"), F.lit(True))
    return one("top") & one("bottom")


def consensus_molecules(bases: DataFrame, params: Params = Params()) -> DataFrame:
    made = molecules(strand_consensus(allele_counts(by_molecule(bases))))
    both = F.col("top_allele").isNotNull() & F.col("bottom_allele").isNotNull()
    agree = both & (F.col("top_allele") == F.col("bottom_allele"))
    return made.withColumns(
        {"both": both, "agree": agree, "q2": agree & passes(params.minConsensusThresholdQ2), "q1": agree & passes(params.minConsensusThresholdQ1)}
    )


def supporting_molecules(bases: DataFrame, params: Params = Params()) -> DataFrame:
    """Molecules that support each allele of each position, by level of consensus."""
    made = consensus_molecules(bases, params).where("agree")
    return made.groupBy(*LOCATION, F.col("top_allele").alias("allele")).agg(
        F.count("*").alias("n_all"), F.count_if("q2").alias("n_good"), F.count_if("q1").alias("n_good_dubious")
    )


def assays(params: Params) -> dict[str, Column]:
    """Quality assays of a molecule, in the order in which they are taken."""
    n = lambda p: F.coalesce(F.col(f"{p}_n_strand"), F.lit(0))
    both = F.col("top_allele").isNotNull() & F.col("bottom_allele").isNotNull()
    # lig_dist is the distance of a base from the nearer ligation site; the farthest base of either strand counts
    farthest = F.greatest(F.coalesce("top_max_lig", F.lit(-1000)), F.coalesce("bottom_max_lig", F.lit(-1000)))
    return {
        "N_READS_PER_STRAND": lattice.graded(
            (n("top") >= params.minReadsPerStrandQ2) & (n("bottom") >= params.minReadsPerStrandQ2),
            (n("top") >= params.minReadsPerStrandQ1) & (n("bottom") >= params.minReadsPerStrandQ1),
        ),
        "TOTAL_N_READS_Q2": lattice.graded(n("top") + n("bottom") >= params.minReadsPerDuplexQ2, F.lit(True)),
        "N_STRAND_READS_ABOVE_Q2_PHRED": lattice.graded(F.coalesce("top_n_q2", F.lit(0)) + F.coalesce("bottom_n_q2", F.lit(0)) > 0, F.lit(True)),
        "CLOSE_TO_LIG": lattice.graded(farthest > params.ignoreFirstNBasesQ2, farthest > params.ignoreFirstNBasesQ1),
        "MISSING_STRAND": lattice.graded(both, F.lit(True)),
        "CONSENSUS": lattice.graded(passes(params.minConsensusThresholdQ2), passes(params.minConsensusThresholdQ1)),
        "DISAGREEMENT": F.when(both & (F.col("top_allele") != F.col("bottom_allele")), lattice.ATROCIOUS),
    }


def graded_molecules(bases: DataFrame, params: Params = Params(), more: dict[str, Column] | None = None) -> DataFrame:
    """Molecules with a column for each assay and their quality; `more` holds further assays by name."""
    return grade(molecules(strand_consensus(allele_counts(by_molecule(bases)))), params, more)


def grade(made: DataFrame, params: Params = Params(), more: dict[str, Column] | None = None) -> DataFrame:
    """`molecules` with a column for each assay and their quality."""
    own = assays(params) | (more or {})
    return made.withColumns(own).withColumn("quality", lattice.combine([F.col(name) for name in own]))


def graded_support(graded: DataFrame) -> DataFrame:
    """Molecules that support each allele of each place, by their quality; atrocious ones support none."""
    kept = graded.where(F.col("quality") > lattice.ATROCIOUS)
    return kept.groupBy(*LOCATION, F.coalesce("top_allele", "bottom_allele").alias("allele")).agg(
        F.count("*").alias("n_all"), F.count_if(F.col("quality") >= lattice.GOOD).alias("n_good"), F.count_if(F.col("quality") >= lattice.DUBIOUS).alias("n_good_dubious")
    )


def molecule_mapping_quality(bases: DataFrame) -> DataFrame:
    """Largest, over reads, of the smaller mapping quality of a read and its mate."""
    return bases.groupBy(*MOLECULE).agg(F.max(F.least("mapq", F.coalesce("mate_mapq", "mapq"))).alias("mapping_quality"))


def disagreements(bases: DataFrame, wildtype: str, params: Params = Params()) -> DataFrame:
    """As `disagreeing`, from bases."""
    return disagreeing(molecules(strand_consensus(allele_counts(by_molecule(bases)))), wildtype, params)


def disagreeing(made: DataFrame, wildtype: Column | str, params: Params = Params()) -> DataFrame:
    """Molecules whose strands agree with themselves but not with each other.

    fst is the wildtype side if there is one, snd the mutant; has_wt tells the two files apart.
    """
    enough = (F.col("top_n_strand") >= params.minReadsPerStrandForDisagreement) & (F.col("bottom_n_strand") >= params.minReadsPerStrandForDisagreement)
    found = made.where((F.col("top_allele") != F.col("bottom_allele")) & enough & passes(params.minConsensusThresholdQ1))
    top_wild, bottom_wild = F.col("top_allele") == wildtype, F.col("bottom_allele") == wildtype
    return found.select(
        *MOLECULE,
        F.when(bottom_wild, F.col("bottom_allele")).otherwise(F.col("top_allele")).alias("fst"),
        F.when(bottom_wild, F.col("top_allele")).otherwise(F.col("bottom_allele")).alias("snd"),
        (top_wild | bottom_wild).alias("has_wt"),
        F.when(passes(params.minConsensusThresholdQ2), lattice.GOOD).otherwise(lattice.DUBIOUS).alias("quality"),
    )


def supported_bases(bases: DataFrame, params: Params = Params()) -> DataFrame:
    """Bases that still support their allele: that of both strands of a molecule that is not atrocious."""
    kept = graded_molecules(bases, params).where(F.col("quality") > lattice.ATROCIOUS)
    agreed = kept.select(*MOLECULE, F.coalesce("top_allele", "bottom_allele").alias("allele"))
    return bases.join(agreed, [*MOLECULE, "allele"], "left_semi")


def intra_strand_mismatches(bases: DataFrame, wildtype: str, least: int = 2, share: float = 0.95) -> DataFrame:
    """Most frequent mutant with `least` reads on a strand whose consensus stays below `share`."""
    counts = allele_counts(bases)
    tops = strand_consensus(counts).where(F.col("n_top") < share * F.col("n_strand"))
    rank = Window.partitionBy(*MOLECULE, "strand").orderBy(F.desc("n"), "allele")
    mutants = counts.where((F.col("allele") != wildtype) & (F.col("n") >= least)).withColumn("r", F.row_number().over(rank)).where("r = 1")
    return mutants.select(*MOLECULE, "strand", "allele", "n").join(tops.select(*MOLECULE, "strand"), [*MOLECULE, "strand"], "left_semi")
