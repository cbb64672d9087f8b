"""Candidates at positions, totals, frequencies, and calls across samples.

`support` has a row for each sample, place (contig, position, half) and allele with n_good,
n_good_dubious and n_all molecules. Sister samples are the other samples at a place; all cross-sample
work is windows over the place, so samples are never joined with each other, and one shuffle serves
all of them. Medians and percentiles keep counts of values, not the values of a deep place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lattice
from ..functions.sequence import safe_ratio
from ..params import Params
from .consensus import LOCATION, MOLECULE, PLACE


def element(value: str, share: float) -> Column:
    """The value at place floor(share * n) from 0 of the n sorted values; counts of distinct values are kept."""
    return F.expr(f"percentile_disc({share + 1e-10:.12f}) WITHIN GROUP (ORDER BY {value})").cast("int")


def candidates(bases: DataFrame, qualities: DataFrame, params: Params = Params()) -> DataFrame:
    """Quality of each allele: from the phred scores and from its molecules' best quality."""
    phred = bases.groupBy(*LOCATION, "allele").agg(element("phred", 0.5).alias("median_phred"), F.count("*").alias("n_reads"))
    best = qualities.groupBy(*LOCATION, F.coalesce("top_allele", "bottom_allele").alias("allele")).agg(
        F.max("quality").alias("max_molecule_quality"), F.count_if(F.col("quality") >= lattice.DUBIOUS).alias("n_q1_molecules")
    )
    made = phred.join(best, [*LOCATION, "allele"], "left")
    own = {
        "CANDIDATE_PHRED": lattice.graded(F.col("median_phred") >= params.minCandidateMedianPhredScore),
        "MAX_MOLECULE_Q": F.coalesce("max_molecule_quality", F.lit(lattice.ATROCIOUS)),
    }
    return made.withColumns(own).withColumn("quality", lattice.combine([F.col("CANDIDATE_PHRED")], [F.col("MAX_MOLECULE_Q")]))


def insert_summary(bases: DataFrame, *more: Column) -> DataFrame:
    """Smallest and largest insert, mean mapping quality and far mates of each allele; `more` aggregates come from the same shuffle."""
    return bases.groupBy(*LOCATION, "allele").agg(
        F.min("insert_size").alias("min_insert"),
        F.max("insert_size").alias("max_insert"),
        F.round(F.avg("mapq"), 6).alias("mean_mapq"),
        F.count_if("wrong_pair").alias("n_far_mates"),
        *more,
    )


def position_statistics(bases: DataFrame) -> DataFrame:
    """Upper median phred (127 if there is none), share of wrong pairs, insert percentiles."""
    return bases.groupBy(*LOCATION).agg(
        F.coalesce(element("phred", 0.5), F.lit(127)).alias("median_phred"),
        F.round(F.avg(F.col("wrong_pair").cast("int")), 9).alias("wrong_pairs"),
        element("insert_size", 0.1).alias("insert_10"),
        element("insert_size", 0.9).alias("insert_90"),
    )


def totals(support: DataFrame) -> DataFrame:
    """Each allele with its position's totals and its frequency among good and dubious molecules."""
    here = Window.partitionBy(*LOCATION)
    sums = {f"total_{c}": F.sum(c).over(here) for c in ("n_good", "n_good_dubious", "n_all")}
    made = support.withColumns(sums)
    return made.withColumn("freq", safe_ratio(F.col("n_good_dubious"), F.col("total_n_good_dubious")))


def ranked(frequencies: DataFrame) -> DataFrame:
    """Alleles in order of frequency; ties by allele."""
    return frequencies.withColumn("rank", F.row_number().over(Window.partitionBy(*LOCATION).orderBy(F.desc("freq"), "allele")))


def top_two(frequencies: DataFrame) -> DataFrame:
    rows = ranked(frequencies)
    return rows.groupBy(*LOCATION).agg(
        F.max(F.when(F.col("rank") == 1, F.col("allele"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("freq"))).alias("top_freq"),
        F.max(F.when(F.col("rank") == 2, F.col("freq"))).alias("second_freq"),
    )


def capped_by_top_frequency(rows: DataFrame, params: Params) -> DataFrame:
    """Quality capped at DUBIOUS at positions whose top frequency is outside the allowed range."""
    top = F.max("freq").over(Window.partitionBy(*LOCATION))
    outside = (top < params.minTopAlleleFreqQ2) | (top > params.maxTopAlleleFreqQ2)
    return rows.withColumn("quality", F.when(outside, F.least("quality", F.lit(lattice.DUBIOUS))).otherwise(F.col("quality")))


def capped_disagreements(disagreements: DataFrame, frequencies: DataFrame, params: Params) -> DataFrame:
    """Disagreements are POOR at most where their mutant is frequent."""
    own = frequencies.select(*LOCATION, F.col("allele").alias("snd"), "freq")
    frequent = F.coalesce(F.col("freq"), F.lit(0.0)) > params.maxMutFreqForDisag
    joined = disagreements.join(own, [*LOCATION, "snd"], "left")
    return joined.withColumn("quality", F.when(frequent, F.least("quality", F.lit(lattice.POOR))).otherwise(F.col("quality")))


def collision_probability(molecules: DataFrame, insert_probability: DataFrame, start: str = "pos") -> DataFrame:
    """1 - (1 - p(size))^n for the n molecules of a start."""
    n = F.count("*").over(Window.partitionBy("sample", "contig", start))
    joined = molecules.withColumn("n_start", n).join(insert_probability, "insert_size", "left")
    return joined.withColumn("p_collision", F.round(1 - F.pow(1 - F.coalesce("p", F.lit(0.0)), F.col("n_start")), 9))


def cross_sample(support: DataFrame, wildtype: str) -> DataFrame:
    """Each allele with what other samples show at its position."""
    here, allele, sample = Window.partitionBy(*PLACE), Window.partitionBy(*PLACE, "allele"), Window.partitionBy(*LOCATION)
    wild = F.col("allele") == wildtype
    rows = totals(support.repartition(*PLACE)).withColumn("sample_wild", F.max(F.when(wild & (F.col("n_all") > 0), 1).otherwise(0)).over(sample))
    return rows.withColumns(
        {
            "n_samples_with_allele": F.count("*").over(allele),
            "sister_coverage": F.sum("n_good_dubious").over(here) - F.col("total_n_good_dubious"),
            "some_without_wildtype": F.min("sample_wild").over(here) == 0,
            "no_wildtype": F.max("sample_wild").over(here) == 0,
            "low_top_frequency": F.min(F.when(F.col("freq") == F.max("freq").over(sample), F.col("freq"))).over(here),
        }
    )


def unique_calls(support: DataFrame, wildtype: str, disagreements: DataFrame, params: Params = Params(), report_below: float | None = None) -> DataFrame:
    """Mutant alleles with the flags that decide whether they are unique to their sample."""
    rows = cross_sample(support, wildtype).where(F.col("allele") != wildtype)
    capped = disagreements.where(F.col("quality") >= lattice.GOOD).select(*LOCATION, F.col("snd").alias("allele")).distinct()
    flagged = rows.join(capped.withColumn("has_disagreement", F.lit(True)), [*LOCATION, "allele"], "left")
    several = F.count_if(F.col("n_good") >= params.minQ2DuplexesToCallMutation).over(Window.partitionBy(*LOCATION)) > 1
    flags = {
        "present_in_sister": F.col("n_samples_with_allele") > 1,
        "several_at_position": several,
        "enough_molecules": (F.col("n_good") >= params.minQ2DuplexesToCallMutation) & (F.col("n_good_dubious") >= params.minQ1Q2DuplexesToCallMutation),
        "sister_covered": F.col("sister_coverage") >= params.minNumberDuplexesSisterSamples,
        "coverage_ok": F.col("total_n_good_dubious") <= params.maxNDuplexes,
        "has_disagreement": F.coalesce("has_disagreement", F.lit(False)),
        "reported": F.col("low_top_frequency") < (params.topAlleleFreqReport if report_below is None else report_below),
    }
    rows = flagged.withColumns(flags)
    unique = ~F.col("present_in_sister") & ~F.col("several_at_position") & F.col("enough_molecules") & F.col("sister_covered") & F.col("coverage_ok")
    if params.Q2DisagCapsMatchingMutationQuality:
        unique = unique & ~F.col("has_disagreement")
    return rows.withColumn("unique_mutation", unique)


def concurring(molecules: DataFrame, params: Params = Params()) -> DataFrame:
    """Molecules of each allele that meet the conditions; the best one always counts.

    Also the smallest and largest distance to it: the larger one of the distances between left starts
    and between right ends.
    """
    best = F.min_by(F.struct("dup", "left_start", "right_end"), F.struct(-F.col("quality"), -F.col("n_reads"), "dup")).over(Window.partitionBy(*LOCATION, "allele"))
    good = (F.col("n_reads") >= params.minConcurringDuplexReads) & (F.col("quality") >= lattice.DUBIOUS)
    rows = molecules.withColumn("best", best).withColumn("counts", good | (F.col("dup") == F.col("best.dup")))
    distance = F.greatest(F.abs(F.col("left_start") - F.col("best.left_start")), F.abs(F.col("right_end") - F.col("best.right_end")))
    return rows.where("counts").groupBy(*LOCATION, "allele").agg(
        F.count("*").alias("n_concurring"), F.min(F.when(F.col("dup") != F.col("best.dup"), distance)).alias("min_distance"), F.max(distance).alias("max_distance")
    )


def detailed(found: DataFrame, bases: DataFrame, graded: DataFrame, params: Params = Params()) -> DataFrame:
    """Calls with what their reads, molecules and places show: inserts, mapping, phred scores, wrong pairs, concurring molecules.

    graded: molecules at places with alleles and quality. Each part is one aggregate over places and alleles, one of them for all that reads show of an allele; only calls are joined to them.
    """
    n = F.coalesce("top_n_strand", F.lit(0)) + F.coalesce("bottom_n_strand", F.lit(0))
    made = graded.select(*MOLECULE, F.coalesce("top_allele", "bottom_allele").alias("allele"), "quality", n.alias("n_reads"))
    places = position_statistics(bases).withColumnRenamed("median_phred", "place_median_phred")
    own = insert_summary(bases, element("phred", 0.5).alias("median_phred"), F.count("*").alias("n_reads"))
    by_allele = [own, concurring(made.join(molecule_ends(bases), MOLECULE), params)]
    rows = found.join(places, LOCATION, "left")
    for part in by_allele:
        rows = rows.join(part, [*LOCATION, "allele"], "left")
    return rows


def molecule_ends(bases: DataFrame) -> DataFrame:
    """Outermost places of each molecule."""
    return bases.groupBy(*MOLECULE).agg(F.min("left_start").alias("left_start"), F.max("right_end").alias("right_end"))


def denominators(support: DataFrame, params: Params = Params()) -> DataFrame:
    """Q2 positions and molecules of each sample where the sister samples were covered too."""
    rows = support.groupBy(*LOCATION).agg(F.sum("n_good").alias("n_good"), F.sum("n_good_dubious").alias("n_gd"))
    sister = F.sum("n_gd").over(Window.partitionBy(*PLACE)) - F.col("n_gd")
    return rows.withColumn("sister", sister).where((F.col("n_good") > 0) & (F.col("sister") >= params.minNumberDuplexesSisterSamples)).groupBy("sample").agg(
        F.count("*").alias("q2_positions"), F.sum("n_good").alias("q2_molecules")
    )


def mutation_rate(calls: DataFrame, denominator: DataFrame) -> DataFrame:
    """Unique calls over Q2 molecules; NaN for none of either."""
    counted = calls.where("unique_mutation").groupBy("sample").agg(F.count("*").alias("n_calls"))
    joined = denominator.join(counted, "sample", "left").fillna(0, ["n_calls"])
    rate = F.coalesce(F.try_divide(F.col("n_calls"), F.col("q2_molecules")), F.lit(float("nan")))
    return joined.select("sample", "n_calls", "q2_molecules", F.round(rate, 9).alias("rate"))


def minimum_coverage(support: DataFrame, n_samples: Column | int) -> DataFrame:
    """Smallest coverage of a position over all samples; a sample without rows has zero."""
    rows = support.groupBy(*LOCATION).agg(F.sum("n_good_dubious").alias("n"))
    return rows.groupBy(*PLACE).agg(F.when(F.count("*") < n_samples, 0).otherwise(F.min("n")).alias("min_coverage"))
