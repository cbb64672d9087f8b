"""Queries over bases: consensus, quality, candidates, calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import calls as K
from ..operators import consensus as C
from ..operators import statistics
from ..operators import stats as S
from ..params import Params
from ..standins import view
from .registry import ORACLE_SQL, query

#: Molecules of the stand-in have about two reads a strand.
PARAMS = Params(minReadsPerStrandQ2=2, minReadsPerStrandQ1=1, minNumberDuplexesSisterSamples=3)
WILD = "A"


def _bases(spark, sf):
    return view(spark, sf, "bases_v")


COUNTS = """counts AS (
  SELECT sample, contig, pos, half, dup, strand, allele, count(*) AS n, count(*) FILTER (phred >= 30) AS n_q2, sum(phred)::BIGINT AS phred_sum, max(lig_dist) AS max_lig
  FROM bases_v GROUP BY ALL)"""
STRANDS = COUNTS + """, strands AS (
  SELECT sample, contig, pos, half, dup, strand, first(allele ORDER BY n DESC, allele) AS top, max(n) AS n_top, first(n_q2 ORDER BY n DESC, allele) AS n_q2,
    sum(n)::BIGINT AS n_strand, max(max_lig) AS max_lig
  FROM counts GROUP BY ALL)"""
MOLECULES = STRANDS + """, mols AS (
  SELECT sample, contig, pos, half, dup,
    max(top) FILTER (strand = 'F') AS top_allele, max(n_top) FILTER (strand = 'F') AS top_n_top, max(n_q2) FILTER (strand = 'F') AS top_n_q2,
    max(n_strand) FILTER (strand = 'F') AS top_n_strand, max(max_lig) FILTER (strand = 'F') AS top_max_lig,
    max(top) FILTER (strand = 'O') AS bottom_allele, max(n_top) FILTER (strand = 'O') AS bottom_n_top, max(n_q2) FILTER (strand = 'O') AS bottom_n_q2,
    max(n_strand) FILTER (strand = 'O') AS bottom_n_strand, max(max_lig) FILTER (strand = 'O') AS bottom_max_lig
  FROM strands GROUP BY ALL)"""


def _passes(share: float) -> str:
    return f"(coalesce(top_n_top >= {share} * top_n_strand, true) AND coalesce(bottom_n_top >= {share} * bottom_n_strand, true))"


CONSENSUS = MOLECULES + f""", agreed AS (
  SELECT *, {_passes(0.95)} AS q2, {_passes(0.51)} AS q1 FROM mols WHERE top_allele = bottom_allele
), support AS (
  SELECT sample, contig, pos, half, top_allele AS allele, count(*) AS n_all, count(*) FILTER (q2) AS n_good, count(*) FILTER (q1) AS n_good_dubious FROM agreed GROUP BY ALL)"""
GRADED = MOLECULES + f""", graded AS (
  SELECT *, least(
      CASE WHEN coalesce(top_n_strand, 0) >= 2 AND coalesce(bottom_n_strand, 0) >= 2 THEN 2 WHEN coalesce(top_n_strand, 0) >= 1 AND coalesce(bottom_n_strand, 0) >= 1 THEN 1 ELSE 0 END,
      CASE WHEN coalesce(top_n_strand, 0) + coalesce(bottom_n_strand, 0) >= 3 THEN 2 ELSE 1 END,
      CASE WHEN coalesce(top_n_q2, 0) + coalesce(bottom_n_q2, 0) > 0 THEN 2 ELSE 1 END,
      CASE WHEN greatest(coalesce(top_max_lig, -1000), coalesce(bottom_max_lig, -1000)) > 35 THEN 2 WHEN greatest(coalesce(top_max_lig, -1000), coalesce(bottom_max_lig, -1000)) > 4 THEN 1 ELSE 0 END,
      CASE WHEN top_allele IS NOT NULL AND bottom_allele IS NOT NULL THEN 2 ELSE 1 END,
      CASE WHEN {_passes(0.95)} THEN 2 WHEN {_passes(0.51)} THEN 1 ELSE 0 END,
      CASE WHEN top_allele <> bottom_allele THEN -1 END) AS quality
  FROM mols)"""
DISAGREEMENTS = MOLECULES + f""", dis AS (
  SELECT sample, contig, pos, half, dup, CASE WHEN bottom_allele = 'A' THEN bottom_allele ELSE top_allele END AS fst,
    CASE WHEN bottom_allele = 'A' THEN top_allele ELSE bottom_allele END AS snd, top_allele = 'A' OR bottom_allele = 'A' AS has_wt,
    CASE WHEN {_passes(0.95)} THEN 2 ELSE 1 END AS quality
  FROM mols WHERE top_allele <> bottom_allele AND {_passes(0.51)})"""
FREQ = CONSENSUS + """, freqs AS (
  SELECT *, sum(n_good) OVER w::BIGINT AS total_n_good, sum(n_good_dubious) OVER w::BIGINT AS total_n_good_dubious, sum(n_all) OVER w::BIGINT AS total_n_all,
    CASE WHEN sum(n_good_dubious) OVER w = 0 THEN 0.0 ELSE n_good_dubious / (sum(n_good_dubious) OVER w) END::DOUBLE AS freq
  FROM support WINDOW w AS (PARTITION BY sample, contig, pos, half))"""


def _support(spark, sf):
    return C.supporting_molecules(_bases(spark, sf), PARAMS)


@query("A09_allele_counts", f"WITH {COUNTS} SELECT * FROM counts")
def a09(spark, sf):
    return C.allele_counts(_bases(spark, sf))


@query("A10_strand_consensus", f"WITH {STRANDS} SELECT * FROM strands")
def a10(spark, sf):
    return C.strand_consensus(C.allele_counts(_bases(spark, sf)))


@query("A11_strand_consensus", f"WITH {CONSENSUS} SELECT * FROM support")
def a11(spark, sf):
    return _support(spark, sf)


@query("A12_molecule_quality", f"WITH {GRADED} SELECT sample, contig, pos, half, dup, quality FROM graded")
def a12(spark, sf):
    return C.graded_molecules(_bases(spark, sf), PARAMS).select("sample", "contig", "pos", "half", "dup", "quality")


@query("P04_extra_assay", f"WITH {GRADED} SELECT sample, contig, pos, half, dup, least(quality, CASE WHEN coalesce(top_n_q2, 0) >= 1 AND coalesce(bottom_n_q2, 0) >= 1 THEN 2 ELSE 1 END) AS quality FROM graded")
def p04(spark, sf):
    """A further assay beside the standard ones: each strand needs a read of good quality."""
    both = (F.coalesce("top_n_q2", F.lit(0)) >= 1) & (F.coalesce("bottom_n_q2", F.lit(0)) >= 1)
    made = C.graded_molecules(_bases(spark, sf), PARAMS, {"GOOD_READ_ON_EACH_STRAND": F.when(both, lattice.GOOD).otherwise(lattice.DUBIOUS)})
    return made.select(*C.MOLECULE, "quality")


@query("A13_molecule_mapping_quality", "SELECT sample, contig, pos, half, dup, max(least(mapq, coalesce(mate_mapq, mapq))) AS mapping_quality FROM bases_v GROUP BY ALL")
def a13(spark, sf):
    return C.molecule_mapping_quality(_bases(spark, sf))


@query("A14_disagreements", f"WITH {DISAGREEMENTS} SELECT * FROM dis")
def a14(spark, sf):
    return C.disagreements(_bases(spark, sf), WILD, PARAMS)


@query("A15_support_removal", f"""WITH {GRADED} SELECT b.sample, b.contig, b.pos, b.half, b.allele, count(*) AS n FROM bases_v b JOIN graded g
  ON b.sample = g.sample AND b.contig = g.contig AND b.pos = g.pos AND b.half = g.half AND b.dup = g.dup AND b.allele = coalesce(g.top_allele, g.bottom_allele) WHERE quality > -1 GROUP BY ALL""")
def a15(spark, sf):
    return C.supported_bases(_bases(spark, sf), PARAMS).groupBy("sample", "contig", "pos", "half", "allele").agg(F.count("*").alias("n"))


@query("A16_candidate_quality", f"""WITH {GRADED}, ph AS (
  SELECT sample, contig, pos, half, allele, list_sort(list(phred))[count(*) // 2 + 1] AS median_phred, count(*) AS n_reads FROM bases_v GROUP BY ALL
), best AS (
  SELECT sample, contig, pos, half, coalesce(top_allele, bottom_allele) AS allele, max(quality) AS max_molecule_quality, count(*) FILTER (quality >= 1) AS n_q1_molecules FROM graded GROUP BY ALL)
SELECT sample, contig, pos, half, allele, median_phred, n_reads, n_q1_molecules, least(CASE WHEN median_phred >= 20 THEN 2 ELSE 0 END, coalesce(max_molecule_quality, -1)) AS quality
FROM ph LEFT JOIN best USING (sample, contig, pos, half, allele)""")
def a16(spark, sf):
    bases = _bases(spark, sf)
    return K.candidates(bases, C.graded_molecules(bases, PARAMS), PARAMS).select("sample", "contig", "pos", "half", "allele", "median_phred", "n_reads", "n_q1_molecules", "quality")


@query("A17_candidate_inserts", """SELECT sample, contig, pos, half, allele, min(insert_size) AS min_insert, max(insert_size) AS max_insert, round(avg(mapq), 6) AS mean_mapq,
  count(*) FILTER (wrong_pair) AS n_far_mates FROM bases_v GROUP BY ALL""")
def a17(spark, sf):
    return K.insert_summary(_bases(spark, sf))


@query("A18_position_statistics", """SELECT sample, contig, pos, half, list_sort(list(phred))[count(*) // 2 + 1] AS median_phred, round(avg(wrong_pair::INT), 9) AS wrong_pairs,
  list_sort(list(insert_size))[floor(count(*) * 0.1)::INT + 1] AS insert_10, list_sort(list(insert_size))[floor(count(*) * 0.9)::INT + 1] AS insert_90 FROM bases_v GROUP BY ALL""")
def a18(spark, sf):
    return K.position_statistics(_bases(spark, sf))


@query("A19_location_totals", f"WITH {FREQ} SELECT sample, contig, pos, half, allele, n_good, total_n_good, total_n_good_dubious, total_n_all FROM freqs")
def a19(spark, sf):
    return K.totals(_support(spark, sf)).select("sample", "contig", "pos", "half", "allele", "n_good", "total_n_good", "total_n_good_dubious", "total_n_all")


@query("A20_allele_frequency", f"WITH {FREQ} SELECT sample, contig, pos, half, allele, round(freq, 9) AS freq FROM freqs")
def a20(spark, sf):
    return K.totals(_support(spark, sf)).select("sample", "contig", "pos", "half", "allele", F.round("freq", 9).alias("freq"))


@query("A21_top_allele_cap", f"""WITH {FREQ} SELECT sample, contig, pos, half, allele, CASE WHEN max(freq) OVER (PARTITION BY sample, contig, pos, half) NOT BETWEEN 0.6 AND 1 THEN least(q, 1) ELSE q END AS quality
  FROM (SELECT *, CASE WHEN n_good > 0 THEN 2 ELSE 0 END AS q FROM freqs)""")
def a21(spark, sf):
    rows = K.totals(_support(spark, sf)).withColumn("quality", F.when(F.col("n_good") > 0, 2).otherwise(0))
    return K.capped_by_top_frequency(rows, Params(minTopAlleleFreqQ2=0.6)).select("sample", "contig", "pos", "half", "allele", "quality")


@query("A22_disagreement_cap", f"""WITH {FREQ}, {DISAGREEMENTS[DISAGREEMENTS.index('dis AS'):]}
SELECT d.sample, d.contig, d.pos, d.half, d.dup, d.snd, CASE WHEN coalesce(freq, 0) > 0.3 THEN least(quality, 0) ELSE quality END AS quality
FROM dis d LEFT JOIN freqs f ON d.sample = f.sample AND d.contig = f.contig AND d.pos = f.pos AND d.half = f.half AND d.snd = f.allele""")
def a22(spark, sf):
    bases = _bases(spark, sf)
    rows = K.capped_disagreements(C.disagreements(bases, WILD, PARAMS), K.totals(C.supporting_molecules(bases, PARAMS)), Params(maxMutFreqForDisag=0.3))
    return rows.select("sample", "contig", "pos", "half", "dup", "snd", "quality")


@query("A23_collision_probability", """WITH p AS (SELECT insert_size, count(*) / (SELECT count(*) FROM bases_v) AS p FROM bases_v GROUP BY 1),
m AS (SELECT sample, contig, pos, half, dup, min(insert_size) AS insert_size FROM bases_v GROUP BY ALL)
SELECT sample, contig, pos, half, dup, round(1 - pow(1 - coalesce(p, 0), count(*) OVER (PARTITION BY sample, contig, pos)), 9) AS p_collision FROM m LEFT JOIN p USING (insert_size)""")
def a23(spark, sf):
    bases = _bases(spark, sf)
    total = bases.count()
    share = bases.groupBy("insert_size").agg((F.count("*") / total).alias("p"))
    rows = bases.groupBy("sample", "contig", "pos", "half", "dup").agg(F.min("insert_size").alias("insert_size"))
    return K.collision_probability(rows, share).select("sample", "contig", "pos", "half", "dup", "p_collision")


CALLS = f"""{FREQ}, {DISAGREEMENTS[DISAGREEMENTS.index('dis AS'):]}, sw AS (
  SELECT *, max(CASE WHEN allele = 'A' AND n_all > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, contig, pos, half) AS sample_wild, max(freq) OVER (PARTITION BY sample, contig, pos, half) AS top_freq FROM freqs
), cross_rows AS (
  SELECT *, count(*) OVER (PARTITION BY contig, pos, half, allele) AS n_samples_with_allele, (sum(n_good_dubious) OVER (PARTITION BY contig, pos, half) - total_n_good_dubious)::BIGINT AS sister_coverage,
    min(sample_wild) OVER (PARTITION BY contig, pos, half) = 0 AS some_without_wildtype, max(sample_wild) OVER (PARTITION BY contig, pos, half) = 0 AS no_wildtype,
    min(CASE WHEN freq = top_freq THEN freq END) OVER (PARTITION BY contig, pos, half) AS low_top_frequency FROM sw
), flagged AS (
  SELECT c.*, n_samples_with_allele > 1 AS present_in_sister, count(*) FILTER (n_good >= 1) OVER (PARTITION BY c.sample, c.contig, c.pos, c.half) > 1 AS several_at_position,
    n_good >= 1 AND n_good_dubious >= 1 AS enough_molecules, sister_coverage >= 3 AS sister_covered, d.snd IS NOT NULL AS has_disagreement, low_top_frequency < 0.3 AS reported
  FROM cross_rows c LEFT JOIN (SELECT DISTINCT sample, contig, pos, half, snd FROM dis WHERE quality >= 2) d ON c.sample = d.sample AND c.contig = d.contig AND c.pos = d.pos AND c.half = d.half AND c.allele = d.snd WHERE c.allele <> 'A'
), called AS (
  SELECT *, NOT present_in_sister AND NOT several_at_position AND enough_molecules AND sister_covered AND NOT has_disagreement AS unique_mutation FROM flagged)"""


def _calls(spark, sf):
    bases = _bases(spark, sf)
    return K.unique_calls(C.supporting_molecules(bases, PARAMS), WILD, C.disagreements(bases, WILD, PARAMS), PARAMS)


FLAGS = "sample, contig, pos, half, allele, n_good, n_good_dubious, sister_coverage, present_in_sister, several_at_position, enough_molecules, sister_covered, has_disagreement, reported, unique_mutation"


@query("A24_unique_calls", f"WITH {CALLS} SELECT {FLAGS} FROM called")
def a24(spark, sf):
    return _calls(spark, sf).select(*FLAGS.split(", "))


@query("A25_concurring_molecules", f"""WITH {GRADED}, ends AS (SELECT sample, contig, pos, half, dup, min(left_start) AS l, max(right_end) AS r FROM bases_v GROUP BY ALL),
m AS (SELECT sample, contig, pos, half, dup, coalesce(top_allele, bottom_allele) AS allele, quality, coalesce(top_n_strand, 0) + coalesce(bottom_n_strand, 0) AS n_reads, l, r FROM graded JOIN ends USING (sample, contig, pos, half, dup)),
b AS (SELECT *, first_value(dup) OVER w AS best, first_value(l) OVER w AS bl, first_value(r) OVER w AS br FROM m WINDOW w AS (PARTITION BY sample, contig, pos, half, allele ORDER BY quality DESC, n_reads DESC, dup)),
d AS (SELECT *, greatest(abs(l - bl), abs(r - br)) AS distance FROM b)
SELECT sample, contig, pos, half, allele, count(*) AS n_concurring, min(CASE WHEN dup <> best THEN distance END) AS min_distance, max(distance) AS max_distance
FROM d WHERE (n_reads >= 2 AND quality >= 1) OR dup = best GROUP BY ALL""")
def a25(spark, sf):
    bases = _bases(spark, sf)
    n = F.coalesce("top_n_strand", F.lit(0)) + F.coalesce("bottom_n_strand", F.lit(0))
    made = C.graded_molecules(bases, PARAMS).select(*C.MOLECULE, F.coalesce("top_allele", "bottom_allele").alias("allele"), "quality", n.alias("n_reads"))
    return K.concurring(made.join(K.molecule_ends(bases), C.MOLECULE), PARAMS)


@query("A26_denominators", f"""WITH {CONSENSUS}, p AS (SELECT sample, contig, pos, half, sum(n_good) AS g, sum(n_good_dubious) AS gd FROM support GROUP BY ALL),
s AS (SELECT *, sum(gd) OVER (PARTITION BY contig, pos, half) - gd AS sister FROM p)
SELECT sample, count(*) AS q2_positions, sum(g)::BIGINT AS q2_molecules FROM s WHERE g > 0 AND sister >= 3 GROUP BY ALL""")
def a26(spark, sf):
    return K.denominators(_support(spark, sf), PARAMS)


@query("A27_mutation_rate", f"""WITH {CALLS}, p AS (SELECT sample, contig, pos, half, sum(n_good) AS g, sum(n_good_dubious) AS gd FROM support GROUP BY ALL),
s AS (SELECT *, sum(gd) OVER (PARTITION BY contig, pos, half) - gd AS sister FROM p),
d AS (SELECT sample, sum(g)::BIGINT AS q2_molecules FROM s WHERE g > 0 AND sister >= 3 GROUP BY ALL), n AS (SELECT sample, count(*) AS n_calls FROM called WHERE unique_mutation GROUP BY ALL)
SELECT sample, coalesce(n_calls, 0) AS n_calls, q2_molecules, round(coalesce(n_calls, 0) / q2_molecules, 9) AS rate FROM d LEFT JOIN n USING (sample)""")
def a27(spark, sf):
    return K.mutation_rate(_calls(spark, sf), K.denominators(_support(spark, sf), PARAMS))


@query("A28_minimum_coverage", f"""WITH {CONSENSUS}, p AS (SELECT contig, pos, half, sample, sum(n_good_dubious) AS n FROM support GROUP BY ALL)
SELECT least(CASE WHEN count(*) < 3 THEN 0 ELSE min(n) END, 4)::BIGINT AS bin, 1 AS one FROM p GROUP BY contig, pos, half""".replace("SELECT least(", "SELECT bin, count(*) AS n FROM (SELECT least(").replace(", 1 AS one FROM p GROUP BY contig, pos, half", " FROM p GROUP BY contig, pos, half) GROUP BY bin"))
def a28(spark, sf):
    return S.histogram(K.minimum_coverage(_support(spark, sf), 3), "min_coverage", 5)


@query("A36_mismatch_spectrum", "SELECT sample, strand, allele, count(*) AS n FROM bases_v WHERE phred >= 20 GROUP BY ALL")
def a36(spark, sf):
    return S.spectrum(_bases(spark, sf).where("phred >= 20"), ["sample", "strand", "allele"])


@query("A37_intra_strand", f"""WITH {STRANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample, contig, pos, half, dup, strand ORDER BY n DESC, allele) AS k FROM counts WHERE allele <> 'A' AND n >= 2)
SELECT r.sample, r.contig, r.pos, r.half, r.dup, r.strand, r.allele, r.n FROM r JOIN strands s USING (sample, contig, pos, half, dup, strand) WHERE k = 1 AND s.n_top < 0.95 * s.n_strand""")
def a37(spark, sf):
    return C.intra_strand_mismatches(_bases(spark, sf), WILD)


@query("A38_disagreement_spectrum", f"""WITH {DISAGREEMENTS}, l AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(c)), d AS (SELECT a.c AS fst, b.c AS snd FROM l a, l b WHERE a.c <> b.c)
SELECT fst, snd, count(sample) AS n FROM d LEFT JOIN dis USING (fst, snd) GROUP BY ALL""")
def a38(spark, sf):
    return S.substitution_spectrum(C.disagreements(_bases(spark, sf), WILD, PARAMS))


TOPS = FREQ + """, rk AS (SELECT *, row_number() OVER (PARTITION BY sample, contig, pos, half ORDER BY freq DESC, allele) AS rank FROM freqs),
tops AS (SELECT sample, contig, pos, half, max(allele) FILTER (rank = 1) AS top, max(freq) FILTER (rank = 1) AS top_freq, max(freq) FILTER (rank = 2) AS second_freq FROM rk GROUP BY ALL)"""


@query("A39_frequency_pairs", f"WITH {TOPS} SELECT coalesce(floor(top_freq * 10)::INT, 99) AS top, coalesce(floor(second_freq * 10)::INT, 99) AS second, count(*) AS n FROM tops GROUP BY ALL")
def a39(spark, sf):
    return S.frequency_pairs(K.top_two(K.totals(_support(spark, sf))))


@query("A40_ligation_phred", "SELECT lig_dist, phred // 5 AS phred_bin, count(*) AS n FROM bases_v GROUP BY ALL")
def a40(spark, sf):
    return S.spectrum(_bases(spark, sf).select("lig_dist", F.floor(F.col("phred") / 5).cast("int").alias("phred_bin")), ["lig_dist", "phred_bin"])


@query("A47_parameter_sweep", "WITH " + MOLECULES + "".join(
    f", s{k} AS (SELECT {v}::DOUBLE AS value, count(*) AS n_agreeing, count(*) FILTER ({_passes(v)}) AS n_good FROM mols WHERE top_allele = bottom_allele)" for k, v in enumerate((0.5, 0.75, 1.0))
) + " SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2")
def a47(spark, sf):
    """Every value of a swept threshold in one pass: molecules are grouped once."""
    made = C.molecules(C.strand_consensus(C.allele_counts(_bases(spark, sf)))).where("top_allele = bottom_allele")
    values = [p.minConsensusThresholdQ2 for p in Params(minConsensusThresholdQ1=0.4).sweep("minConsensusThresholdQ2", 0.5, 1.0, 3)]
    counts = made.agg(F.count("*").alias("n"), *[F.count_if(C.passes(v)).alias(f"g{k}") for k, v in enumerate(values)])
    rows = F.array(*[F.struct(F.lit(v).alias("value"), F.col("n").alias("n_agreeing"), F.col(f"g{k}").alias("n_good")) for k, v in enumerate(values)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("A48_read_histogram", f"WITH {STRANDS} SELECT least(n_strand, 4) AS bin, count(*) AS n FROM strands GROUP BY ALL")
def a48(spark, sf):
    return S.histogram(C.strand_consensus(C.allele_counts(_bases(spark, sf))), "n_strand", 5)


@query("W01_ranked_candidates", f"WITH {TOPS} SELECT sample, contig, pos, half, allele, rank FROM rk")
def w01(spark, sf):
    return K.ranked(K.totals(_support(spark, sf))).select("sample", "contig", "pos", "half", "allele", F.col("rank").cast("long").alias("rank"))


@query("W02_sister_coverage", f"WITH {CALLS} SELECT sample, contig, pos, half, allele, sister_coverage FROM cross_rows")
def w02(spark, sf):
    return K.cross_sample(_support(spark, sf), WILD).select("sample", "contig", "pos", "half", "allele", "sister_coverage")


@query("W03_samples_with_allele", f"WITH {CALLS} SELECT sample, contig, pos, half, allele, n_samples_with_allele FROM cross_rows")
def w03(spark, sf):
    return K.cross_sample(_support(spark, sf), WILD).select("sample", "contig", "pos", "half", "allele", "n_samples_with_allele")


@query("W04_wildtype_support", f"WITH {CALLS} SELECT sample, contig, pos, half, allele, some_without_wildtype, no_wildtype FROM cross_rows")
def w04(spark, sf):
    return K.cross_sample(_support(spark, sf), WILD).select("sample", "contig", "pos", "half", "allele", "some_without_wildtype", "no_wildtype")


@query("W05_low_top_frequency", f"WITH {CALLS} SELECT sample, contig, pos, half, allele, round(low_top_frequency, 9) AS low_top_frequency FROM cross_rows")
def w05(spark, sf):
    return K.cross_sample(_support(spark, sf), WILD).select("sample", "contig", "pos", "half", "allele", F.round("low_top_frequency", 9).alias("low_top_frequency"))


@query("J09_samples_at_position", "SELECT contig, pos, half, count(DISTINCT sample) AS n_samples, count(*) AS n_bases FROM bases_v GROUP BY ALL")
def j09(spark, sf):
    return _bases(spark, sf).groupBy(*C.PLACE).agg(F.countDistinct("sample").alias("n_samples"), F.count("*").alias("n_bases"))


@query("J10_same_allele", f"WITH {CALLS} SELECT contig, pos, half, allele, count(*) AS n FROM cross_rows WHERE n_samples_with_allele > 1 GROUP BY ALL")
def j10(spark, sf):
    rows = K.cross_sample(_support(spark, sf), WILD)
    return rows.where("n_samples_with_allele > 1").groupBy(*C.PLACE, "allele").agg(F.count("*").alias("n"))


@query("U01_union_samples", "SELECT sample, count(*) AS n FROM bases_v GROUP BY ALL")
def u01(spark, sf):
    bases = _bases(spark, sf)
    parts = [bases.where(F.col("sample") == s) for s in "ANR"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sample").agg(F.count("*").alias("n"))


@query("U03_distinct_molecules", "SELECT DISTINCT sample, contig, pos, half, dup FROM bases_v")
def u03(spark, sf):
    return _bases(spark, sf).select("sample", "contig", "pos", "half", "dup").distinct()


@query("U04_duplicate_positions", "SELECT sample, contig, pos, half, dup, strand, count(*) AS n FROM bases_v GROUP BY ALL HAVING count(*) > 1")
def u04(spark, sf):
    return _bases(spark, sf).groupBy("sample", "contig", "pos", "half", "dup", "strand").agg(F.count("*").alias("n")).where("n > 1")


@query("K01_detection_table", f"""WITH {CALLS} SELECT CASE WHEN unique_mutation THEN '*' ELSE '' END AS flag, sample || ':' || contig || ':' || (pos + 1) || CASE WHEN half THEN '.5' ELSE '' END AS place, sample, contig, pos + 1 AS position, half, allele,
  n_good, n_good_dubious, n_all, round(freq, 6) AS freq, sister_coverage FROM called""")
def k01(spark, sf):
    from ..sources import sinks

    return sinks.detection_rows(_calls(spark, sf))


@query("K01_detection_details", f"""WITH {CALLS}, inserts AS ({ORACLE_SQL["A17_candidate_inserts"]}), places AS ({ORACLE_SQL["A18_position_statistics"]}), near AS ({ORACLE_SQL["A25_concurring_molecules"]}),
own AS (SELECT sample, contig, pos, half, allele, list_sort(list(phred))[count(*) // 2 + 1] AS median_phred, count(*) AS n_reads FROM bases_v GROUP BY ALL)
SELECT CASE WHEN unique_mutation THEN '*' ELSE '' END AS flag, sample || ':' || contig || ':' || (pos + 1) || CASE WHEN half THEN '.5' ELSE '' END AS place, sample, contig, pos + 1 AS position, half, allele, n_good, n_good_dubious, n_all, round(freq, 6) AS freq, sister_coverage,
  n_reads, own.median_phred, places.median_phred AS place_median_phred, wrong_pairs, min_insert, max_insert, insert_10, insert_90, mean_mapq, n_far_mates, n_concurring, min_distance, max_distance
FROM called LEFT JOIN inserts USING (sample, contig, pos, half, allele) LEFT JOIN near USING (sample, contig, pos, half, allele) LEFT JOIN own USING (sample, contig, pos, half, allele) LEFT JOIN places USING (sample, contig, pos, half)""")
def k01_details(spark, sf):
    """The detection table with the measurements of every call."""
    from ..sources import sinks

    bases = _bases(spark, sf)
    rows = K.detailed(_calls(spark, sf), bases, C.graded_molecules(bases, PARAMS), PARAMS)
    return sinks.detection_rows(rows, sinks.DETAILS[:13])


@query("K02_mutation_bed", f"WITH {CALLS} SELECT contig, pos AS start, pos AS \"end\", allele, sample FROM called WHERE unique_mutation")
def k02(spark, sf):
    from ..sources import sinks

    return sinks.mutation_bed(_calls(spark, sf))


@query("K03_disagreement_bed", f"WITH {DISAGREEMENTS} SELECT contig, pos AS start, pos AS \"end\", fst || '->' || snd AS change, sample FROM dis WHERE has_wt")
def k03(spark, sf):
    from ..sources import sinks

    return sinks.disagreement_bed(C.disagreements(_bases(spark, sf), WILD, PARAMS), True)


@query("K04_coverage_bed", f"WITH {CONSENSUS} SELECT sample, contig, pos AS start, pos AS \"end\", sum(n_good_dubious)::BIGINT AS molecules FROM support WHERE NOT half GROUP BY ALL HAVING molecules > 0")
def k04(spark, sf):
    from ..sources import sinks

    return sinks.coverage_bed(_support(spark, sf))


@query("K06_json_rows", f"""WITH {CONSENSUS} SELECT sample, contig, pos, half, '{{"candidates":[' || string_agg('{{"allele":"' || allele || '","n_good":' || n_good || '}}', ',' ORDER BY allele) || ']}}' AS json FROM support GROUP BY ALL""")
def k06(spark, sf):
    from ..sources import sinks

    return sinks.json_rows(_support(spark, sf).select("sample", "contig", "pos", "half", "allele", "n_good"), ["sample", "contig", "pos", "half"])


@query("K11_variants", f"""WITH {CONSENSUS}, k AS (SELECT *, translate(allele, '^-', '') AS seq FROM support WHERE allele <> 'A')
SELECT contig, pos + 1 AS pos, CASE WHEN allele LIKE '-%' THEN 'A' || seq ELSE 'A' END AS ref, CASE WHEN allele LIKE '-%' THEN 'A' WHEN allele LIKE '^%' THEN 'A' || seq ELSE seq END AS alt,
  string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM k GROUP BY contig, 2, ref, alt""")
def k11(spark, sf):
    from ..sources import sinks

    rows = _support(spark, sf).where("allele <> 'A'")
    allele = F.col("allele")
    return sinks.variants(rows.select("contig", "pos", C.kind_of(allele).alias("kind"), F.lit("A").alias("wt"), C.letters_of(allele).alias("seq"), "sample"))


@query("J11_annotated_candidates", f"""WITH {CONSENSUS}, l AS (SELECT DISTINCT 'A' AS sample, 'c2' AS contig, p_partkey AS pos, false AS half, 'T' AS allele FROM part WHERE p_size < 20)
SELECT l.sample, l.contig, l.pos, l.half, l.allele, CASE WHEN s.n_all IS NULL THEN 'NOT FOUND' ELSE 'FOUND' END AS outcome FROM l LEFT JOIN support s USING (sample, contig, pos, half, allele)""")
def j11(spark, sf):
    from ..session import table
    from ..sources import sinks

    listed = table(spark, sf, "part").where("p_size < 20").select(F.lit("A").alias("sample"), F.lit("c2").alias("contig"), F.col("p_partkey").alias("pos"), F.lit(False).alias("half"), F.lit("T").alias("allele")).distinct()
    return sinks.annotated_list(listed, _support(spark, sf).select("sample", "contig", "pos", "half", "allele"), ["sample", "contig", "pos", "half", "allele"])


@query("B01_read_statistics", statistics.sql(statistics.READS, "reads_v"))
def b01(spark, sf):
    return statistics.collect(view(spark, sf, "reads_v"), statistics.READS)


@query("B02_molecule_statistics", f"WITH {GRADED} " + statistics.sql(statistics.MOLECULES, "graded"))
def b02(spark, sf):
    return statistics.collect(C.graded_molecules(_bases(spark, sf), PARAMS), statistics.MOLECULES)


@query("B03_allele_statistics", f"WITH {FREQ} " + statistics.sql(statistics.ALLELES, "freqs"))
def b03(spark, sf):
    return statistics.collect(K.totals(_support(spark, sf)), statistics.ALLELES)
