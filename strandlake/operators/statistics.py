"""Named statistics as a table: each is a predicate, a key and a clamp over one of the row sets.

All statistics of a row set come from one pass: a row is turned into its (statistic, key) pairs,
which are counted with a combine before the only shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Statistic:
    """Counts rows that meet `when`, by `key` (clamped to `clamp` - 1 for histograms) or altogether."""

    name: str
    when: str = "true"
    key: str | None = None
    clamp: int | None = None

    def key_sql(self) -> str:
        if self.key is None:
            return "''"
        value = f"least({self.key}, {self.clamp - 1})" if self.clamp else self.key
        return f"CAST({value} AS STRING)"


READS = [
    Statistic("nRecordsInFile"),
    Statistic("nRecordsProcessed", "flag & 1 <> 0 AND flag & 4 = 0 AND flag & 256 = 0 AND mapq >= 20"),
    Statistic("ignoredUnpairedReads", "flag & 1 = 0"),
    Statistic("nRecordsUnmapped", "flag & 4 <> 0"),
    Statistic("nRecordsIgnoredBecauseSecondary", "flag & 256 <> 0"),
    Statistic("nRecordsBelowMappingQualityThreshold", "mapq < 20"),
    Statistic("nReadMedianPhredBelowThreshold", "median_phred < 20"),
    Statistic("mappingQualityAllRecords", "true", "mapq", 500),
    Statistic("mappingQualityKeptRecords", "mapq >= 20", "mapq", 500),
    Statistic("medianReadPhredQuality", "true", "median_phred", 500),
    Statistic("nReadsInsertNoSize", "insert_size = 0"),
    Statistic("nReadsInsertSizeAboveMaximum", "abs(insert_size) > 1000"),
    Statistic("nReadsInsertSizeBelowMinimum", "abs(insert_size) < 100"),
    Statistic("nReadsPairTandem", "orientation = 'TANDEM'"),
    Statistic("nReadsPairRF", "orientation = 'RF'"),
    Statistic("nReadsOpticalTile", "true", "line", None),
    Statistic("readInsertSize", "insert_size > 0", "insert_size", 1000),
    Statistic("nMateOutOfReach", "contig <> mate_contig"),
    Statistic("nClippedBases", "true", "n_clipped", 50),
]
#: Over molecules of both strands (top_*, bottom_*), with their quality.
MOLECULES = [
    Statistic("nPosDuplex"),
    Statistic("nPosDuplexBothStrandsPresent", "top_allele IS NOT NULL AND bottom_allele IS NOT NULL"),
    Statistic("nPosDuplexTooFewReadsPerStrand1", "coalesce(top_n_strand, 0) < 1 OR coalesce(bottom_n_strand, 0) < 1"),
    Statistic("nPosDuplexTooFewReadsPerStrand2", "coalesce(top_n_strand, 0) < 2 OR coalesce(bottom_n_strand, 0) < 2"),
    Statistic("nPosDuplexTooFewReadsAboveQ2Phred", "coalesce(top_n_q2, 0) + coalesce(bottom_n_q2, 0) = 0"),
    Statistic("nPosDuplexWithLackOfStrandConsensus1", "top_n_top < 0.51 * top_n_strand OR bottom_n_top < 0.51 * bottom_n_strand"),
    Statistic("nPosDuplexWithLackOfStrandConsensus2", "top_n_top < 0.95 * top_n_strand OR bottom_n_top < 0.95 * bottom_n_strand"),
    Statistic("nPosDuplexWithTopBottomDuplexDisagreement", "top_allele <> bottom_allele"),
    Statistic("nPosDuplexCandidatesForDisagreementQ2", "quality = 2 OR (top_allele <> bottom_allele AND top_n_strand >= 2 AND bottom_n_strand >= 2)"),
    Statistic("duplexTotalRecords", "true", "coalesce(top_n_strand, 0) + coalesce(bottom_n_strand, 0)", 500),
    Statistic("duplexMissingStrandReads", "top_allele IS NULL OR bottom_allele IS NULL", "coalesce(top_n_strand, bottom_n_strand)", 50),
    Statistic("duplexStrandImbalance", "top_allele IS NOT NULL AND bottom_allele IS NOT NULL", "abs(top_n_strand - bottom_n_strand)", 50),
    Statistic("consensusQuality", "true", "quality", None),
    Statistic("wtAcceptedBaseDistanceToLigationSite", "top_allele = 'A' AND top_max_lig < 35", "top_max_lig", 200),
    Statistic("wtRejectedDistanceToLigationSite", "top_allele = 'A' AND top_max_lig >= 35", "top_max_lig", 200),
    Statistic("rejectedSubstDistanceToLigationSite", "top_allele <> 'A' AND top_max_lig >= 35", "top_max_lig", 200),
]
#: Over alleles of positions, with totals and frequencies.
ALLELES = [
    Statistic("nPosCandidates"),
    Statistic("nPosCandidatesQ2", "n_good > 0"),
    Statistic("nPosCandidatesForUniqueMutation", "allele <> 'A' AND n_good > 0"),
    Statistic("nPosQualityPoor", "n_good_dubious = 0"),
    Statistic("nPosQualityPoorA", "n_good_dubious = 0 AND allele = 'A'"),
    Statistic("nPosQualityPoorT", "n_good_dubious = 0 AND allele = 'T'"),
    Statistic("wtQ2CandidateQ1Q2Coverage", "allele = 'A' AND n_good > 0", "total_n_good_dubious", 200),
    Statistic("mutantQ2CandidateQ1Q2Coverage", "allele <> 'A' AND n_good > 0", "total_n_good_dubious", 200),
    Statistic("minTopCandFreqQ2PosTopAlleleFreqOK", "freq >= 0.5", "CAST(floor(freq * 10) AS INT)", 11),
    Statistic("minTopCandFreqQ2PosTopAlleleFreqKO", "freq < 0.5", "CAST(floor(freq * 10) AS INT)", 11),
    Statistic("nDuplexesPerAllele", "true", "n_all", 100),
]


def collect(rows: DataFrame, statistics: list[Statistic]) -> DataFrame:
    """(statistic, key, n); statistics that no row meets are absent."""
    pairs = [F.when(F.expr(s.when), F.struct(F.lit(s.name).alias("statistic"), F.expr(s.key_sql()).alias("key"))) for s in statistics]
    met = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return rows.select(F.explode(met).alias("p")).groupBy("p.statistic", "p.key").agg(F.count("*").alias("n"))


def sql(statistics: list[Statistic], source: str) -> str:
    """The same as SQL over a view."""
    return " UNION ALL ".join(f"SELECT '{s.name}' AS statistic, {s.key_sql()} AS key, count(*) AS n FROM {source} WHERE {s.when} GROUP BY ALL HAVING count(*) > 0" for s in statistics)
