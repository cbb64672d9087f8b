"""Queries over reads: filters, scalar functions, mates, molecules and toolkit programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from ..operators import molecules as M
from ..operators import reads as R
from ..operators import toolkit as T
from ..operators import transcripts
from ..operators.order import numbered
from ..params import Params
from ..session import table
from ..sources import readers, sinks
from ..standins import view
from .registry import query

PARAMS = Params(nConstantBarcodeMismatchesAllowed=1, minReadMedianPhredScore=20)


def _reads(spark, sf):
    return view(spark, sf, "reads_v")


def _molecules(spark, sf):
    return view(spark, sf, "molecules_v")


MISMATCH = " + ".join(f"CASE WHEN substring(const_bc, {k}, 1) NOT IN (substring('TCT', {k}, 1), 'N') THEN 1 ELSE 0 END" for k in (1, 2, 3))
KEPT = {
    "F01_paired": "flag & 1 <> 0",
    "F02_mapped": "flag & 4 = 0",
    "F03_primary": "flag & 256 = 0",
    "F04_mapping_quality": "mapq >= 20",
    "F05_insert_range": "abs(insert_size) BETWEEN 0 AND 1000",
    "F06_orientation": "orientation NOT IN ('TANDEM', 'RF')",
    "F07_constant_barcode": f"({MISMATCH}) <= 1",
    "F08_median_phred": "median_phred >= 20",
    "F09_nonzero_insert": "insert_size <> 0",
    "F14_contig": "NOT regexp_matches(lower(contig), 'decoy|_alt|_random|hla-|chrun_')",
    "F21_q2_read": "NOT wrong_pair AND n_clipped <= 15 AND mapq >= 50 AND abs(insert_size) <= 1000",
    "F22_mate_mapped": "flag & 8 = 0",
    "F25_odd_pair": "wrong_pair OR abs(insert_size) > 1000 OR contig <> mate_contig",
    "F26_insert_sample": "insert_size <> 0 AND mapq >= 50 AND abs(insert_size) < 1000",
}


def _register_filters() -> None:
    for name, condition in KEPT.items():

        def run(spark, sf, name=name):
            return _reads(spark, sf).where(R.filters(PARAMS)[name]).select("order_id", "line", "start")

        query(name, f"SELECT order_id, line, start FROM reads_v WHERE {condition}")(run)


_register_filters()


@query("F00_filter_ledger", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (NOT ({c})) AS dropped FROM reads_v" for n, c in KEPT.items()) + ")")
def f00(spark, sf):
    return R.filter_ledger(_reads(spark, sf), R.filters(PARAMS))


BASE_KEPT = {"F10_base_phred": "phred >= 20", "F11_ligation": "lig_dist >= 4", "F12_read_end": "read_place < 28", "F24_inside_contig": "pos < 150"}


def _register_base_filters() -> None:
    for name, condition in BASE_KEPT.items():

        def run(spark, sf, name=name):
            rows = view(spark, sf, "bases_v").withColumns({"read_place": F.col("lig_dist") % 32, "read_length": F.lit(32), "contig_length": F.lit(150)})
            return rows.where(R.base_filters()[name]).select("sample", "pos", "dup", "strand", "phred", "lig_dist")

        query(name, f"SELECT sample, pos, dup, strand, phred, lig_dist FROM (SELECT *, lig_dist % 32 AS read_place FROM bases_v) WHERE {condition}")(run)


_register_base_filters()


@query("F13_position_range", "SELECT order_id, line FROM reads_v WHERE contig = 'chrA' AND start BETWEEN 50 AND 120")
def f13(spark, sf):
    return _reads(spark, sf).where((F.col("contig") == "chrA") & F.col("start").between(50, 120)).select("order_id", "line")


@query("F16_first_records", "SELECT order_id, line, start, cigar, seq, qual FROM reads_v ORDER BY ALL LIMIT 100")
def f16(spark, sf):
    return _reads(spark, sf).select("order_id", "line", "start", "cigar", "seq", "qual").orderBy("order_id", "line", "start", "cigar", "seq", "qual").limit(100)


@query("F17_drop_pairs", "SELECT qname, line FROM reads_v WHERE ('0x' || substring(md5('4:' || qname), 1, 8))::BIGINT % 1000000 >= 300000")
def f17(spark, sf):
    return R.drop_pairs(_reads(spark, sf), 0.3, seed=4).select("qname", "line")


@query("F18_random_mate_order", "SELECT qname, line, CASE WHEN ('0x' || substring(md5('4:' || qname), 1, 8))::BIGINT % 1000000 % 2 = 1 AND flag & 1 <> 0 THEN xor(flag, 192) ELSE flag END AS flag FROM reads_v")
def f18(spark, sf):
    return R.random_mate_order(_reads(spark, sf), seed=4).select("qname", "line", "flag")


@query("F19_one_per_key", "SELECT order_id, line, max(mapq) AS mapq, count(*) OVER () AS n_kept FROM reads_v GROUP BY order_id, line")
def f19(spark, sf):
    rows = R.one_per_key(_reads(spark, sf), ["order_id", "line"])
    kept = rows.select("order_id", "line", "mapq")
    return kept.join(F.broadcast(kept.agg(F.count("*").alias("n_kept"))))


@query("F20_seen_often", """WITH f AS (SELECT order_id, start FROM reads_v WHERE mapq >= 10 UNION ALL SELECT order_id, start FROM reads_v WHERE mapq >= 30 AND line < 4),
k AS (SELECT order_id, start FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT r.order_id, r.line, r.start FROM reads_v r JOIN k USING (order_id, start)""")
def f20(spark, sf):
    rows = _reads(spark, sf)
    return R.seen_often(rows, [(rows, 10), (rows.where("line < 4"), 30)], ["order_id", "start"], 2).select("order_id", "line", "start")


@query("J12_semi_join", """WITH k AS (SELECT order_id, start FROM (SELECT order_id, start FROM reads_v WHERE mapq >= 0 UNION ALL SELECT order_id, start FROM reads_v WHERE mapq >= 0) GROUP BY ALL HAVING count(*) >= 3)
SELECT order_id, start, count(*) AS n FROM reads_v JOIN k USING (order_id, start) GROUP BY ALL""")
def j12(spark, sf):
    rows = _reads(spark, sf)
    return R.seen_often(rows, [(rows, 0), (rows, 0)], ["order_id", "start"], 3).groupBy("order_id", "start").agg(F.count("*").alias("n"))


@query("F23_optical_excluded")
def f23(spark, sf):
    return _optical(spark, sf).where("NOT coalesce(optical_duplicate, false)").select("read_id", "order_id")


# ---- scalar functions, one query each

EFFECTIVE = "CASE WHEN negative THEN greatest(length(regexp_replace(seq, '^N+', '')), 1) ELSE length(regexp_replace(seq, 'N+$', '')) END"
PHREDS = "list_transform(string_split(qual, ''), lambda q: ascii(q) - 33)"
COMP = "translate({}, 'ACGTNYRWSBDHKMVacgtnyrwsbdhkmv', 'TGCANRYWSVHDMKBtgcanrywsvhdmkb')"
BC = "nullif(regexp_extract(qname, 'BC:Z:([A-Z]+)', 1), '')"
HAMMING = " + ".join(
    f"CASE WHEN substring(const_bc, {k}, 1) <> substring(seq, {k}, 1) AND substring(const_bc, {k}, 1) <> 'N' AND substring(seq, {k}, 1) <> 'N' THEN 1 ELSE 0 END" for k in (1, 2, 3)
)
SCORE = " + ".join(f"CASE WHEN substring(seq, {k}, 1) = 'N' THEN 0 WHEN substring(seq, {k}, 1) = substring(const_bc, {k}, 1) THEN 1 ELSE -1 END" for k in (1, 2, 3))
_OPS = "list_transform(regexp_extract_all(cigar, '\\d+[{}]'), lambda e: regexp_extract(e, '\\d+')::INT)"


def _sum_ops(ops: str) -> str:
    return f"coalesce(list_sum({_OPS.format(ops)}), 0)::INT"


LEAD = "coalesce(nullif(regexp_extract(cigar, '^(\\d+)S', 1), '')::INT, 0)"
TRAIL = "coalesce(nullif(regexp_extract(cigar, '(\\d+)S$', 1), '')::INT, 0)"
END = f"(start + {_sum_ops('MDN')} - 1)"


class _Row:
    """Columns that several functions share."""

    def __init__(self):
        self.seq, self.qual, self.cigar, self.start = F.col("seq"), F.col("qual"), F.col("cigar"), F.col("start")
        place = F.concat("contig", F.lit(":1,"), F.lpad((F.col("start") % 1000).cast("string"), 3, "0"))
        self.contig, self.pos, self.half = S.parse_location(place)
        self.i7, self.i5 = S.header_indexes(F.concat(F.lit("@r 1:N:0:"), F.substring("seq", 1, 4), F.lit("+"), F.substring("seq", 5, 4)))
        change = (
            F.when(F.col("line") == 1, F.concat(F.lit("-"), F.substring("seq", 1, 3), F.lit("-")))
            .when(F.col("line") == 2, F.concat(F.lit("^"), F.substring("seq", 1, 2), F.lit("^")))
            .otherwise(F.substring("seq", 1, 2))
        )
        self.kind, self.wildtype, self.sequence = S.parse_change(change)
        self.split = C.split_read(self.cigar, self.start)


#: Scalar functions: name, columns over reads, and the SQL of each.
FUNCTIONS = {
    "X01_read_key": (lambda r: {"v": F.concat_ws("--", "qname", F.when(F.col("is_first"), "1").otherwise("2"), F.concat(F.when(F.col("negative"), "-").otherwise("+"), r.start.cast("string")))}, {"v": "qname || '--' || CASE WHEN is_first THEN '1' ELSE '2' END || '--' || CASE WHEN negative THEN '-' ELSE '+' END || start"}),
    "X02_barcodes": (lambda r: {"var_bc": F.substring(S.name_barcode(F.col("qname")), 1, 3), "const_part": F.substring(S.name_barcode(F.col("qname")), 4, 3)}, {"var_bc": f"substring({BC}, 1, 3)", "const_part": f"substring({BC}, 4, 3)"}),
    "X03_effective_length": (lambda r: {"v": S.effective_length(r.seq, F.col("negative"))}, {"v": f"({EFFECTIVE})::INT"}),
    "X04_read_phreds": (lambda r: {"median": S.upper_median(S.phreds(r.qual)), "mean": S.integer_mean(S.phreds(r.qual)), "first_half": S.integer_mean(F.slice(S.phreds(r.qual), 1, 16))}, {"median": f"list_sort({PHREDS})[17]", "mean": f"floor(list_sum({PHREDS}) / 32)::INT", "first_half": f"floor(list_sum({PHREDS}[1:16]) / 16)::INT"}),
    "X05_clipped_bases": (lambda r: {"v": C.clipped_bases(r.cigar, r.start, F.col("negative"), F.lit(None).cast("int"))}, {"v": f"{LEAD} + {TRAIL}"}),
    "X06_aligned_blocks": (lambda r: {"*": F.element_at(F.transform(F.array(C.aligned_blocks(r.cigar, r.start)), lambda b: F.struct(F.size(b).alias("n"), F.element_at(b, -1)["ref"].alias("last_ref"))), 1)}, {"n": "len(regexp_extract_all(cigar, '\\d+M'))::INT", "last_ref": f"({END} - regexp_extract(cigar, '(\\d+)M[^M]*$', 1)::INT + 1)::INT"}),
    "X07_read_position": (lambda r: {"inside": C.read_position(r.cigar, r.start, r.start), "before": C.read_position(r.cigar, r.start, r.start - 3)}, {"inside": LEAD, "before": f"{LEAD} - 3"}),
    "X08_ligation_distance": (lambda r: {"v": C.ligation_distance(F.col("n_clipped"), F.col("median_phred"), 35)}, {"v": "greatest(35 - n_clipped, 35 - median_phred)"}),
    "X09_orientation": (lambda r: {"v": C.pair_orientation(F.col("negative"), F.col("line") > 3, r.start, F.col("mate_start"))}, {"v": "CASE WHEN negative = (line > 3) THEN 'TANDEM' WHEN CASE WHEN negative THEN mate_start ELSE start END <= CASE WHEN negative THEN start ELSE mate_start END THEN 'FR' ELSE 'RF' END"}),
    "X10_duplex_left": (lambda r: {"v": F.when(F.col("wrong_pair"), r.start <= F.col("mate_start")).otherwise(~F.col("negative")), "rev": F.when(F.col("wrong_pair"), r.start <= F.col("mate_start")).otherwise(~F.col("negative")) != F.col("is_first")}, {"v": "CASE WHEN wrong_pair THEN start <= mate_start ELSE NOT negative END", "rev": "CASE WHEN wrong_pair THEN start <= mate_start ELSE NOT negative END <> is_first"}),
    "X11_intron_end": (lambda r: {"v": C.intron_adjusted_end(r.cigar, r.start, 30)}, {"v": f"CASE WHEN cigar LIKE '%N%' THEN start + 7 ELSE {END} END::INT"}),
    "X12_reverse_complement": (lambda r: {"v": S.reverse_complement(r.seq)}, {"v": COMP.format("reverse(seq)")}),
    "X13_barcode_distance": (lambda r: {"v": S.mismatches(F.col("const_bc"), F.substring(r.seq, 1, 3), 3)}, {"v": f"({HAMMING})::INT"}),
    "X14_iupac_match": (lambda r: {"v": S.matches_reference(F.substring(r.seq, 1, 1), F.when(F.col("line") == 1, "Y").when(F.col("line") == 2, "R").otherwise("A"))}, {"v": "CASE WHEN line = 1 THEN substring(seq, 1, 1) IN ('C', 'T', 'Y') WHEN line = 2 THEN substring(seq, 1, 1) IN ('A', 'G', 'R') ELSE substring(seq, 1, 1) = 'A' END"}),
    "X15_context": (lambda r: {"v": S.context(r.seq, r.start % 32)}, {"v": "substring(seq, greatest(start % 32 - 5, 0) + 1, least(start % 32 + 5, 31) - greatest(start % 32 - 5, 0) + 1)"}),
    "X16_locations": (lambda r: {"contig": r.contig, "pos": r.pos, "half": r.half, "text": S.format_location(F.col("contig"), r.start, F.col("negative"))}, {"contig": "contig", "pos": "(1000 + start % 1000 - 1)::INT", "half": "false", "text": "contig || ':' || (start + 1) || CASE WHEN negative THEN '.5' ELSE '' END"}),
    "X17_tile": (lambda r: {"tile": S.run_tile(F.col("qname")), "x": S.tile_coordinate(F.col("qname"), 6), "y": S.tile_coordinate(F.col("qname"), 7)}, {"tile": "array_to_string(string_split(qname, ':')[1:5], ':')", "x": "string_split(qname, ':')[6]::INT", "y": "regexp_extract(string_split(qname, ':')[7], '^\\d+')::INT"}),
    "X18_quality_bounds": (lambda r: {"low": F.least("mapq", F.when(F.col("line") == 1, F.col("n_clipped"))), "high": F.greatest("mapq", F.when(F.col("line") == 1, F.col("n_clipped")))}, {"low": "least(mapq, CASE WHEN line = 1 THEN n_clipped END)", "high": "greatest(mapq, CASE WHEN line = 1 THEN n_clipped END)"}),
    "X20_distances": (lambda r: {"chebyshev": S.chebyshev(r.start, F.col("mate_start"), F.col("mapq"), F.col("n_clipped")), "euclid": S.euclid(r.start, F.col("mate_start"), F.col("mapq"), F.col("n_clipped"))}, {"chebyshev": "greatest(abs(start - mapq), abs(mate_start - n_clipped))", "euclid": "floor(sqrt((start - mapq) ** 2 + (mate_start - n_clipped) ** 2))::INT"}),
    "X21_split_reads": (lambda r: {"left": r.split["left_clip"], "right": r.split["right_clip"], "matched": r.split["matched"]}, {"left": LEAD, "right": TRAIL, "matched": f"list_max({_OPS.format('M')})"}),
    "X22_supplementary": (lambda r: {"v": C.supplementary(F.concat(F.lit("chr2,"), (r.start + 1).cast("string"), F.lit(",-,10S22M,33,0;"))).getField("start")}, {"v": "start"}),
    "X23_rearrangement": (lambda r: {"v": C.rearrangement(F.col("contig"), r.start, F.col("negative"), F.col("mate_contig"), F.col("mate_start") - 100, F.col("is_first"))}, {"v": "CASE WHEN contig <> mate_contig THEN 'INTERCHROMOSOMAL' WHEN negative <> is_first THEN 'INVERSION' WHEN mate_start - 100 < start THEN 'TANDEM_REPEAT' ELSE 'DELETION' END"}),
    "X24_strand": (lambda r: {"v": F.when(F.col("negative") == F.col("is_first"), "BOTTOM").otherwise("TOP")}, {"v": "CASE WHEN negative = is_first THEN 'BOTTOM' ELSE 'TOP' END"}),
    "X25_contig_bin": (lambda r: {"v": F.floor(r.start / 250).cast("int")}, {"v": "(start // 250)::INT"}),
    "X26_index_score": (lambda r: {"v": S.index_score(r.seq, F.col("const_bc"), 3)}, {"v": f"({SCORE})::INT"}),
    "X27_header_indexes": (lambda r: {"i7": r.i7, "i5": r.i5}, {"i7": "substring(seq, 1, 4)", "i5": "substring(seq, 5, 4)"}),
    "X28_adapter": (lambda r: {"v": S.mask_from(r.seq, F.when(F.instr(r.seq, "GGC") > 0, F.instr(r.seq, "GGC"))), "bc": F.substring(r.seq, 1, 6)}, {"v": "CASE WHEN instr(seq, 'GGC') > 0 THEN substring(seq, 1, instr(seq, 'GGC') - 1) || repeat('N', 32 - instr(seq, 'GGC') + 1) ELSE seq END", "bc": "substring(seq, 1, 6)"}),
    "X01_mate_key": (
        lambda r: {
            "own": S.read_key(F.col("qname"), F.col("is_first"), F.col("negative"), r.start, F.col("flag").bitwiseAND(F.lit(2048)) != 0),
            "mate": S.read_key(F.col("qname"), ~F.col("is_first"), F.col("line") % 2 == 0, F.col("mate_start"), F.lit(False)),
        },
        {
            "own": "qname || '--' || CASE WHEN is_first THEN 1 ELSE 2 END || '--' || CASE WHEN negative THEN '-' ELSE '+' END || start || CASE WHEN flag & 2048 <> 0 THEN '--suppl' ELSE '' END",
            "mate": "qname || '--' || CASE WHEN is_first THEN 2 ELSE 1 END || '--' || CASE WHEN line % 2 = 0 THEN '-' ELSE '+' END || mate_start",
        },
    ),
    "X28_adapter_search": (
        lambda r: {"at": S.adapter_start(r.seq, "GATCGGAA")},
        {
            "at": "list_sort(list_filter(list_transform(range(1, 29), lambda k: {'share': levenshtein(substring(seq, k::INT, least(33 - k, 8)::INT), substring('GATCGGAA', 1, least(33 - k, 8)::INT))::DOUBLE / least(33 - k, 8), 'at': k::INT, "
            "'fits': levenshtein(substring(seq, k::INT, least(33 - k, 8)::INT), substring('GATCGGAA', 1, least(33 - k, 8)::INT)) * 8 <= 3 * least(33 - k, 8)}), lambda f: f.fits))[1].at"
        },
    ),
    "X29_change_text": (lambda r: {"v": S.change_text(r.kind, F.coalesce(r.wildtype, F.lit("")), r.sequence), "kind": r.kind}, {"v": "CASE WHEN line = 1 THEN '-' || substring(seq, 1, 3) || '-' WHEN line = 2 THEN '^' || substring(seq, 1, 2) || '^' ELSE substring(seq, 1, 1) || '->' || substring(seq, 2, 1) END", "kind": "CASE WHEN line = 1 THEN 'DELETION' WHEN line = 2 THEN 'INSERTION' ELSE 'SUBSTITUTION' END"}),
    "X30_trimmed": (lambda r: {"cigar": C.trim_soft_clips(r.cigar, r.seq)["cigar"], "seq": C.trim_soft_clips(r.cigar, r.seq)["seq"], "clip": C.overlap_clip(C.reference_end(r.cigar, r.start), F.col("mate_start"))}, {"cigar": "regexp_replace(regexp_replace(cigar, '^\\d+S', ''), '\\d+S$', '')", "seq": f"substring(seq, {LEAD} + 1, 32 - {LEAD} - {TRAIL})", "clip": f"greatest(0, {END} - mate_start + 1)::INT"}),
    "X31_formatted": (lambda r: {"v": F.format_number(r.start * 1000, 0)}, {"v": "format('{:,}', start * 1000)"}),
    "X32_safe_ratio": (lambda r: {"v": F.round(S.safe_ratio(F.col("mapq"), F.col("n_clipped")), 9)}, {"v": "round(CASE WHEN n_clipped = 0 THEN 0 ELSE mapq / n_clipped END, 9)"}),
    "X33_coding_strand": (lambda r: {"v": F.col("negative") != F.col("is_first")}, {"v": "negative <> is_first"}),
    "V22_sequence_metrics": (lambda r: {"gc": F.round(T.gc_share(r.seq), 9), "n": F.length(F.regexp_replace(r.seq, "[^N]", ""))}, {"gc": "round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(regexp_replace(seq, '[^ACGT]', '', 'g')), 9)", "n": "length(regexp_replace(seq, '[^N]', '', 'g'))::INT"}),
}


def _register_functions() -> None:
    for name, (_, sql) in FUNCTIONS.items():

        def run(spark, sf, name=name):
            reads = _reads(spark, sf)
            made = FUNCTIONS[name][0](_Row())
            if "*" in made:
                # a struct that is made once, and its fields
                return reads.select("order_id", "line", made["*"].alias("made")).select("order_id", "line", "made.*")
            return reads.select("order_id", "line", *[c.alias(n) for n, c in made.items()])

        query(name, "SELECT order_id, line, " + ", ".join(f"{s} AS {n}" for n, s in sql.items()) + " FROM reads_v")(run)


_register_functions()


# ---- mates, samples and molecules

ONE = """one AS (SELECT order_id, is_first, first(start ORDER BY mapq DESC, start, cigar) AS start, max(mapq) AS mapq, first(cigar ORDER BY mapq DESC, start, cigar) AS cigar FROM reads_v GROUP BY ALL)"""


@query("J01_mates", f"WITH {ONE} SELECT a.order_id, a.is_first, a.start, a.mapq, m.start AS mate_start, m.mapq AS mate_mapq FROM one a LEFT JOIN one m ON a.order_id = m.order_id AND a.is_first <> m.is_first")
def j01(spark, sf):
    rows = _reads(spark, sf).select("order_id", "is_first", "start", "mapq", "cigar")
    return R.with_mates(rows, ["order_id"]).select("order_id", "is_first", "start", "mapq", "mate_start", "mate_mapq")


@query("J02_distant_partner", """SELECT a.order_id, a.line, a.start, b.start AS partner_start FROM reads_v a JOIN reads_v b ON a.order_id = b.order_id AND a.is_first = b.is_first
  WHERE b.start <> a.start AND abs(b.start - a.mate_start) <= 150""")
def j02(spark, sf):
    rows = _reads(spark, sf).withColumn("qname", F.col("order_id"))
    return R.distant_partner(rows, rows, 150).select("order_id", "line", "start", "partner_start")


@query("X23_junctions", """WITH s AS (SELECT qname, is_first, line % 2 = 1 AS right_, contig AS c1, CASE WHEN line % 2 = 1 THEN start + 19 ELSE start END AS p1, mate_contig AS c2, CASE WHEN line % 3 = 1 THEN mate_start + 11 ELSE mate_start END AS p2, line % 3 = 1 AS right2, negative <> (order_id % 5 = 0) AS turned FROM reads_v WHERE flag & 4 = 0 AND flag & 256 = 0),
o AS (SELECT *, right_ = right2 AS same, CASE WHEN right_ = right2 THEN (c1, p1) <= (c2, p2) ELSE right_ END AS fwd FROM s),
j AS (SELECT qname, is_first, CASE WHEN fwd THEN c1 ELSE c2 END AS contig, CASE WHEN fwd THEN p1 ELSE p2 END AS place, CASE WHEN fwd THEN c2 ELSE c1 END AS other_contig, CASE WHEN fwd THEN p2 ELSE p1 END AS other_place, turned OR same AS turned FROM o),
k AS (SELECT DISTINCT qname, is_first, CASE WHEN contig <> other_contig THEN 'INTERCHROMOSOMAL' WHEN turned THEN 'INVERSION' WHEN other_place < place THEN 'TANDEM_REPEAT' ELSE 'DELETION' END AS kind, contig, place, other_contig, other_place FROM j)
SELECT kind, contig, place::INT AS place, other_contig, other_place::INT AS other_place, count(*) AS n FROM k GROUP BY ALL""")
def x23_junctions(spark, sf):
    """Split reads made of the stand-in's, with the other half in a tag; junctions of all kinds with their reads."""
    from ..operators import rearrangements

    other = F.concat_ws(",", "mate_contig", (F.col("mate_start") + 1).cast("string"), F.when(F.col("order_id") % 5 == 0, "-").otherwise("+"), F.when(F.col("line") % 3 == 1, "12M20S").otherwise("20S12M"), F.lit("60"), F.lit("0;"))
    rows = _reads(spark, sf).withColumns({"sample": F.lit("s"), "tags": F.create_map(F.lit("SA"), other), "cigar": F.when(F.col("line") % 2 == 1, "20M12S").otherwise("12S20M")})
    found = rearrangements.junctions(rows).groupBy("kind", "place", "other_place", "contig", "other_contig").agg(F.count("*").alias("n"))
    return found.select("kind", *rearrangements.SIDES, "n")


@query("J03_reference_bases", """WITH r AS (SELECT 'chr' || c AS contig, string_agg(translate(md5(c || k::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), '' ORDER BY k) AS seq FROM (VALUES ('A'), ('N'), ('R')) v(c), range(0, 700) t(k) GROUP BY c)
SELECT x.contig, x.start AS pos, substring(r.seq, x.start + 1, 1) AS wt, count(*) AS n FROM reads_v x JOIN r ON x.contig = r.contig GROUP BY ALL""")
def j03(spark, sf):
    from ..operators import pileup

    letters = F.translate(F.md5(F.concat("c", F.col("k").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    each = spark.createDataFrame([("A",), ("N",), ("R",)], "c string").select("c", F.explode(F.sequence(F.lit(0), F.lit(699))).alias("k")).withColumn("s", letters)
    contigs = each.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]), "").alias("seq")).select(F.concat(F.lit("chr"), "c").alias("contig"), "seq")
    chunks = pileup.reference_chunks(contigs, 1000)
    rows = _reads(spark, sf).select("contig", F.col("start").alias("pos")).join(F.broadcast(contigs.select("contig")), "contig", "left_semi")
    return pileup.with_reference(rows, chunks, 1000).groupBy("contig", "pos", "wt").agg(F.count("*").alias("n"))


@query("J13_neighbours", """WITH m AS (SELECT sample, strand, contig, molecule, left_start, right_end FROM molecules_v), d AS (SELECT unnest(range(-5, 6)) AS d)
SELECT a.molecule AS a, b.molecule AS b FROM m a, d JOIN m b ON a.sample = b.sample AND a.strand = b.strand AND a.contig = b.contig AND b.left_start = a.left_start + d
WHERE d <> 0 AND a.molecule < b.molecule AND abs(a.right_end - b.right_end) <= 5 AND a.right_end <> b.right_end""")
def j13(spark, sf):
    return M.neighbours(_molecules(spark, sf), keys=("sample", "strand", "contig"))


def _optical(spark, sf):
    """In the order of order_id, line, start, seq, qual and cigar; in the view seq follows from start and cigar from line, so they break no tie."""
    order = ["order_id", "line", "start", "qual"]
    rows = _reads(spark, sf).select(
        *order, S.run_tile(F.col("qname")).alias("run_tile"),
        S.tile_coordinate(F.col("qname"), 6).alias("x"), S.tile_coordinate(F.col("qname"), 7).alias("y"), F.col("median_phred").alias("avg_phred"),
    )
    ordered = numbered(rows, order, "read_id", keep=["order_id", "start", "run_tile", "x", "y", "avg_phred"])
    return M.optical_duplicates(ordered.withColumn("molecule", F.floor(F.col("start") / 8)).drop("start"), 6, ["molecule"])


@query("J15_optical_duplicates")
def j15(spark, sf):
    return _optical(spark, sf).select("read_id", "order_id", "optical_duplicate")


@query("J18_identical_barcodes", """WITH b AS (SELECT substring(seq, 1, 4) AS code, start, mate_start, qname, row_number() OVER (PARTITION BY substring(seq, 1, 4) ORDER BY start, mate_start, qname) AS r FROM reads_v WHERE line = 2)
SELECT a.qname, b.qname AS other, b.code, b.start, b.mate_start FROM reads_v a JOIN b ON substring(a.seq, 1, 4) = b.code AND a.start = b.start AND a.mate_start = b.mate_start WHERE b.r = 1 AND a.line = 3""")
def j18(spark, sf):
    rows = _reads(spark, sf).select("qname", F.col("seq").alias("barcode"), "start", "mate_start", "line")
    return R.identical_barcodes(rows.where("line = 3").drop("line"), rows.where("line = 2").drop("line"), 4)


@query("J20_best_sample", """WITH s AS (SELECT n_nationkey AS position, n_name AS sample, substring(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) AS i7, substring(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 9, 8) AS i5 FROM nation),
r AS (SELECT DISTINCT order_id AS id FROM reads_v), q AS (SELECT id, substring(translate(md5(id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 8) AS i7, substring(translate(md5(id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), 9, 8) AS i5 FROM r),
p AS (SELECT id, sample, position, """ + " + ".join(f"CASE WHEN substring(q.{c}, {k}, 1) = 'N' THEN 0 WHEN substring(q.{c}, {k}, 1) = substring(s.{c}, {k}, 1) THEN 1 ELSE -1 END" for c in ("i7", "i5") for k in range(1, 9)) + """ AS score FROM q, s),
b AS (SELECT id, arg_max(sample, score * 1000 - position) AS sample, max(score) AS score FROM p GROUP BY id) SELECT id, CASE WHEN score >= 2 THEN sample ELSE 'LOUSY' END AS sample, score FROM b""")
def j20(spark, sf):
    code = lambda c: F.translate(F.md5(c.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    sheet = table(spark, sf, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("sample"), F.substring(code(F.col("n_name")), 1, 8).alias("i7"), F.substring(code(F.col("n_name")), 9, 8).alias("i5"))
    ids = _reads(spark, sf).select(F.col("order_id").alias("id")).distinct()
    letters = F.translate(F.md5(F.col("id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    reads = ids.select("id", F.substring(letters, 1, 8).alias("i7"), F.substring(letters, 9, 8).alias("i5"))
    return R.best_sample(reads, sheet, 8, least=2).select("id", "sample", "score")


@query("A01_molecule_keys", "SELECT sample, contig, left_start, right_end, left_bc, right_bc, count(*) AS n FROM molecules_v GROUP BY ALL")
def a01(spark, sf):
    rows = M.exact_groups(_molecules(spark, sf), forced_by_name=False)
    return rows.groupBy("molecule_key").agg(*[F.first(c).alias(c) for c in M.KEY], F.count("*").alias("n")).drop("molecule_key")


@query("A01_forced_by_name", "SELECT sample, qname, 1 AS n_molecules FROM molecules_v GROUP BY ALL")
def a01_forced(spark, sf):
    rows = M.exact_groups(_molecules(spark, sf))
    return rows.groupBy("sample", "qname").agg(F.countDistinct("molecule_key").cast("int").alias("n_molecules"))


def _codes_differ(a, b):
    """SQL: letters that differ between two three-letter codes, N fitting anything."""
    return " + ".join(f"(CASE WHEN {a}[{k}] <> {b}[{k}] AND {a}[{k}] <> 'N' AND {b}[{k}] <> 'N' THEN 1 ELSE 0 END)" for k in (1, 2, 3))


def _fits(k, x):
    return f"({_codes_differ(f'{k}.left_bc', f'{x}.left_bc')}) <= 1 AND ({_codes_differ(f'{k}.right_bc', f'{x}.right_bc')}) <= 1"


#: Molecules of one place in their order, and those that stay: each that no earlier one that stays fits.
MERGED = f"""one AS (SELECT * FROM molecules_v QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY left_start, left_start + 100, left_bc, right_bc, n_top, n_bottom) = 1),
g AS (SELECT sample, contig, left_start, list(struct_pack(molecule := molecule, left_bc := left_bc, right_bc := right_bc) ORDER BY n_top + n_bottom DESC, least(n_top, n_bottom) DESC, left_bc, right_bc, molecule) AS o FROM one GROUP BY ALL),
h AS (SELECT o, list_reduce(list_transform(o, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {_fits("k", "y[1]")})) > 0 THEN acc ELSE acc || y END) AS stay FROM g),
merged AS (SELECT x.molecule AS molecule, x.left_bc AS left_bc, list_filter(stay, lambda k: {_fits("k", "x")})[1] AS t FROM (SELECT stay, unnest(o) AS x FROM h))"""


@query("A02_fuzzy_merge", f"WITH {MERGED} SELECT molecule, t.molecule AS merged_into FROM merged")
def a02(spark, sf):
    return M.fuzzy_merge(_single(spark, sf), 0, 1, ["sample", "contig"]).select("molecule", "merged_into")


def _single(spark, sf):
    """One row of the stand-in for each molecule."""
    from pyspark.sql import Window

    first = Window.partitionBy("molecule").orderBy("left_start", "right_end", "left_bc", "right_bc", "n_top", "n_bottom")
    rows = _molecules(spark, sf).withColumn("right_end", F.col("left_start") + 100)
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


@query("A03_barcode_consensus", """WITH c AS (SELECT sample, contig, left_start, left_bc FROM molecules_v),
l AS (SELECT sample, contig, left_start, k, substring(left_bc, k, 1) AS c FROM c, (SELECT unnest([1, 2, 3]) AS k)), n AS (SELECT sample, contig, left_start, k, c, count(*) AS n FROM l WHERE c <> 'N' GROUP BY ALL),
r AS (SELECT sample, contig, left_start, k, c, n, count(*) OVER (PARTITION BY sample, contig, left_start, k, n) AS same, max(n) OVER (PARTITION BY sample, contig, left_start, k) AS top FROM n),
p AS (SELECT sample, contig, left_start, k, max(CASE WHEN n = top AND same = 1 THEN c END) AS c FROM r GROUP BY ALL),
g AS (SELECT sample, contig, left_start, count(*) AS n_reads FROM molecules_v GROUP BY ALL)
SELECT g.sample, g.contig, g.left_start, string_agg(coalesce(p.c, 'N'), '' ORDER BY ks.k) AS consensus, any_value(n_reads) AS n_reads FROM g CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) ks LEFT JOIN p ON p.sample = g.sample AND p.contig = g.contig AND p.left_start = g.left_start AND p.k = ks.k GROUP BY g.sample, g.contig, g.left_start""")
def a03(spark, sf):
    return M.barcode_consensus(_molecules(spark, sf), ["sample", "contig", "left_start"], "left_bc", 3)


@query("A04_molecule_summary", """SELECT sample, contig, left_start, right_end, count(*) AS n_reads, count(*) FILTER (strand = 'F') AS n_top, count(*) FILTER (strand <> 'F') AS n_bottom, min(abs(insert_size)) AS min_insert, max(abs(insert_size)) AS max_insert,
  sum(n_clipped)::BIGINT // count(*) AS avg_clipped, sum(CASE WHEN negative THEN 1 ELSE -1 END) > 0 AS top_is_negative, bool_or(wrong_pair) AS has_wrong_pair FROM molecules_v GROUP BY ALL""")
def a04(spark, sf):
    return M.molecule_summary(_molecules(spark, sf), ["sample", "contig", "left_start", "right_end"])


@query("A06_molecule_statistics", "SELECT sample, contig, left_start, count(*) AS n_reads, sum(n_clipped)::BIGINT // count(*) AS avg_clipped, bool_or(wrong_pair) AS has_wrong_pair FROM molecules_v GROUP BY ALL")
def a06(spark, sf):
    return M.molecule_summary(_molecules(spark, sf), ["sample", "contig", "left_start"]).select("sample", "contig", "left_start", "n_reads", "avg_clipped", "has_wrong_pair")


@query("A05_insert_probability")
def a05(spark, sf):
    return M.insert_probability(_molecules(spark, sf)).withColumn("p", F.round("p", 12))


@query("A07_covering_clipping", """WITH m AS (SELECT contig, left_start AS s, left_start + 20 AS e, n_clipped AS c FROM molecules_v),
d AS (SELECT contig, loc, sum(d)::BIGINT AS d, sum(c)::BIGINT AS c FROM (SELECT contig, s AS loc, 1 AS d, c FROM m UNION ALL SELECT contig, e + 1, -1, -c FROM m) GROUP BY ALL),
r AS (SELECT contig, loc AS start, lead(loc) OVER w - 1 AS "end", (sum(d) OVER w)::BIGINT AS n, sum(c) OVER w AS total FROM d WINDOW w AS (PARTITION BY contig ORDER BY loc))
SELECT contig, start, "end", n, round(total / n, 6) AS mean_clipping FROM r WHERE n > 0 AND "end" IS NOT NULL""")
def a07(spark, sf):
    rows = _molecules(spark, sf)
    return M.covering_clipping(rows.select("contig", F.col("left_start").alias("start"), (F.col("left_start") + 20).alias("end"), "n_clipped"))


#: Blocks of the stand-in's alignments, by hand.
BLOCKS = """blk(cigar, op, ref, read, len) AS (VALUES ('32M', 'M', 0, 0, 32), ('5S27M', 'M', 0, 5, 27), ('12M3D20M', 'M', 0, 0, 12), ('12M3D20M', 'D', 12, 12, 3), ('12M3D20M', 'M', 15, 12, 20),
  ('10M2I16M4S', 'M', 0, 0, 10), ('10M2I16M4S', 'I', 10, 10, 2), ('10M2I16M4S', 'M', 10, 12, 16), ('8M100N20M4S', 'M', 0, 0, 8), ('8M100N20M4S', 'N', 8, 8, 100), ('8M100N20M4S', 'M', 108, 8, 20))"""
SHOWN = BLOCKS + """, e AS (SELECT order_id, line, contig, start, seq, qual, op, ref, read, len, unnest(range(0, CASE WHEN op = 'I' THEN 1 ELSE len END)) AS k FROM reads_v JOIN blk USING (cigar)),
shown AS (SELECT order_id, line, contig, start + ref + k AS pos, false AS half, substring(seq, (read + k + 1)::INT, 1) AS seq, op, ascii(substring(qual, (read + k + 1)::INT, 1)) - 33 AS phred, false AS hidden FROM e WHERE op = 'M'
  UNION ALL SELECT order_id, line, contig, start + ref + k, true, '', 'H', NULL, false FROM e WHERE op = 'M' AND k < len - 1
  UNION ALL SELECT order_id, line, contig, start + ref - 1, true, substring(seq, read + 1, len), 'I', NULL, false FROM e WHERE op = 'I'
  UNION ALL SELECT order_id, line, contig, start + ref + k, false, (start + ref) || '+' || len, op, NULL, k > 0 FROM e WHERE op IN ('D', 'N'))"""


@query("A08_pileup", f"""WITH {SHOWN} SELECT contig, pos::INT AS pos, half, CASE op WHEN 'I' THEN 'INSERTION' WHEN 'D' THEN 'DELETION' WHEN 'N' THEN 'INTRON' WHEN 'M' THEN CASE WHEN shown.seq = 'A' THEN 'WILDTYPE' ELSE 'SUBSTITUTION' END ELSE 'WILDTYPE' END AS kind,
  CASE WHEN hidden THEN '' ELSE seq END AS seq, count(*) AS n_reads, sum(phred)::BIGINT AS phred_sum, bool_and(hidden) AS hidden FROM shown GROUP BY ALL""")
def a08(spark, sf):
    from ..operators import pileup

    return pileup.counted(_reads(spark, sf), _letters_a(_reads(spark, sf)))


def _letters_a(reads):
    """Reference chunks of nothing but A, as long as the reads need."""
    last = reads.agg(F.coalesce(F.max("start"), F.lit(0)).alias("last")).first()["last"] + 200
    chunks = reads.sparkSession.range(last // 10_000 + 1).select(F.col("id").cast("int").alias("chunk"), F.repeat(F.lit("A"), F.lit(11_000)).alias("seq"))
    return chunks.withColumn("contig", F.explode(F.array(*[F.lit(c) for c in ("chrA", "chrN", "chrR", "chrUn_7")])))


@query("V22_edit_distance", f"""WITH {SHOWN}, r AS (SELECT order_id, line, contig, pos, half, op, seq, hidden FROM shown)
SELECT order_id, line, count(*) FILTER (op = 'M' AND seq <> 'A') AS mismatches,
  (count(*) FILTER (op = 'M' AND seq <> 'A') + coalesce(sum(length(seq)) FILTER (op = 'I'), 0) + count(*) FILTER (op = 'D'))::BIGINT AS nm FROM r GROUP BY ALL""")
def v22_edits(spark, sf):
    from ..operators import pileup

    rows = _reads(spark, sf)
    return pileup.edit_distance(rows, ["order_id", "line"], _letters_a(rows))


@query("W06_molecules_per_start", "SELECT sample, contig, left_start, count(*) AS n FROM molecules_v GROUP BY ALL")
def w06(spark, sf):
    return _molecules(spark, sf).groupBy("sample", "contig", "left_start").agg(F.count("*").alias("n"))


@query("W09_start_islands", """WITH d AS (SELECT DISTINCT sample, contig || left_bc || right_bc AS contig, left_start FROM molecules_v), n AS (SELECT *, CASE WHEN left_start - lag(left_start) OVER w <= 2 THEN 0 ELSE 1 END AS f FROM d WINDOW w AS (PARTITION BY sample, contig ORDER BY left_start))
SELECT sample, contig, left_start, sum(f) OVER (PARTITION BY sample, contig ORDER BY left_start)::BIGINT AS island FROM n""")
def w09(spark, sf):
    # barcodes as part of the contig, so that starts leave gaps
    rows = _molecules(spark, sf).select("sample", F.concat("contig", "left_bc", "right_bc").alias("contig"), "left_start").distinct()
    return M.start_islands(rows, 2)


@query("L02_capped_molecules", """WITH m AS (SELECT molecule, contig, left_start, CAST(n_bottom % 4 - 1 AS INT) AS quality, n_top AS n_reads FROM molecules_v QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY n_top, n_bottom, left_start, insert_size) = 1),
c AS (SELECT *, sum(CASE WHEN quality < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, left_start ORDER BY quality DESC, molecule ROWS UNBOUNDED PRECEDING) AS below FROM m)
SELECT molecule, quality AS "DQ", n_reads AS "DN" FROM c WHERE quality >= 2 OR below <= 3""")
def l02(spark, sf):
    from pyspark.sql import Window

    first = Window.partitionBy("molecule").orderBy("n_top", "n_bottom", "left_start", "insert_size")
    rows = _molecules(spark, sf).withColumn("r", F.row_number().over(first)).where("r = 1")
    graded = rows.select("molecule", "contig", "left_start", (F.col("n_bottom") % 4 - 1).cast("int").alias("quality"), F.col("n_top").alias("n_reads"))
    return sinks.annotated_reads(graded.select("molecule"), graded, ["molecule"], most_below_q2=3)


@query("L03_collapsed_reads", "SELECT start, line, max(mapq) AS mapq FROM reads_v GROUP BY ALL")
def l03(spark, sf):
    rows = _reads(spark, sf).select("start", F.col("line").alias("strand"), "mapq", F.col("order_id").alias("read_id"))
    return sinks.collapsed(rows, ["start"]).select("start", F.col("strand").alias("line"), "mapq")


@query("O01_coordinate_sort", "SELECT contig, start, count(*) AS n, row_number() OVER (ORDER BY contig, start) AS place FROM reads_v GROUP BY contig, start")
def o01(spark, sf):
    return numbered(_reads(spark, sf).groupBy("contig", "start").agg(F.count("*").alias("n")), ["contig", "start"])


@query("K09_sam_lines", "SELECT qname || chr(9) || flag || chr(9) || contig || chr(9) || (start + 1) || chr(9) || mapq || chr(9) || cigar || chr(9) || mate_contig || chr(9) || (mate_start + 1) || chr(9) || insert_size || chr(9) || seq || chr(9) || qual || chr(9) || 'DQ:Z:' || line AS value FROM reads_v")
def k09(spark, sf):
    rows = _reads(spark, sf).withColumns({"tlen": F.col("insert_size"), "tags": F.create_map(F.lit("DQ"), F.col("line").cast("string"))})
    return sinks.sam_lines(rows)


# ---- stand-alone programs

@query("V01_mark_duplicates", """WITH p AS (SELECT order_id * 10 + line AS pair_id, line AS library, contig, start AS five_prime, start + abs(insert_size) AS mate_five_prime, orientation, max(mapq) AS score FROM reads_v GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY library, contig, five_prime, mate_five_prime, orientation ORDER BY score DESC, pair_id) > 1 AS duplicate FROM p""")
def v01(spark, sf):
    return T.mark_duplicates(_pairs(spark, sf))


def _pairs(spark, sf):
    return _reads(spark, sf).groupBy(
        (F.col("order_id") * 10 + F.col("line")).alias("pair_id"), F.col("line").alias("library"), "contig", F.col("start").alias("five_prime"),
        (F.col("start") + F.abs("insert_size")).alias("mate_five_prime"), "orientation",
    ).agg(F.max("mapq").alias("score"))


#: Fragments: reads of the fifth line, at the places of pairs of the same library a step on, or at none.
_FRAGMENTS = "SELECT order_id AS pair_id, (order_id % 7)::INT AS library, contig, start + order_id % 3 AS five_prime, max(mapq) AS score FROM reads_v WHERE line = 5 GROUP BY ALL"


@query("V01_duplicate_fragments", f"""WITH f AS ({_FRAGMENTS}), e AS (SELECT DISTINCT line AS library, contig, start AS five_prime, true AS here FROM reads_v)
SELECT pair_id, library, contig, five_prime, score, coalesce(here, false) OR row_number() OVER (PARTITION BY library, contig, five_prime ORDER BY score DESC, pair_id) > 1 AS duplicate FROM f LEFT JOIN e USING (library, contig, five_prime)""")
def v01_fragments(spark, sf):
    rows = _reads(spark, sf).where("line = 5").groupBy(F.col("order_id").alias("pair_id"), (F.col("order_id") % 7).cast("int").alias("library"), "contig", (F.col("start") + F.col("order_id") % 3).alias("five_prime"))
    return T.duplicate_fragments(rows.agg(F.max("mapq").alias("score")), _pairs(spark, sf)).select("pair_id", "library", "contig", "five_prime", "score", "duplicate")


#: The size of each library, by halving what it lies between.
_SIZED = """pair AS (SELECT order_id * 10 + line AS pair_id, line AS library, contig, start AS a, start + abs(insert_size) AS b, orientation, max(mapq) AS score FROM reads_v GROUP BY ALL),
marked AS (SELECT library, row_number() OVER (PARTITION BY library, contig, a, b, orientation ORDER BY score DESC, pair_id) > 1 AS copy FROM pair),
counted AS (SELECT library, count(*) AS pairs, count(*) FILTER (NOT copy) AS uniq FROM marked GROUP BY library),
halved AS (SELECT library, pairs, uniq, 1.0::DOUBLE AS low, 100.0::DOUBLE AS high, -1 AS k FROM counted WHERE pairs > uniq
  UNION ALL SELECT library, pairs, uniq, CASE WHEN k >= 0 AND v > 0 THEN m ELSE low END, CASE WHEN k < 0 AND v > 0 THEN high * 10 WHEN k >= 0 AND v <= 0 THEN m ELSE high END, CASE WHEN k < 0 AND v > 0 THEN k ELSE k + 1 END
  FROM (SELECT *, uniq / (m * uniq) - 1 + exp(-pairs / (m * uniq)) AS v FROM (SELECT *, CASE WHEN k < 0 THEN high ELSE (low + high) / 2 END AS m FROM halved WHERE k < 40))),
sized AS (SELECT library, pairs, uniq AS "unique", floor(uniq * (low + high) / 2)::BIGINT AS library_size FROM halved WHERE k = 40 UNION ALL SELECT library, pairs, uniq, NULL FROM counted WHERE pairs <= uniq)"""


def _sizes(spark, sf):
    marked = T.mark_duplicates(_pairs(spark, sf)).groupBy("library").agg(F.count("*").alias("pairs"), F.count_if(~F.col("duplicate")).alias("unique"))
    return T.library_sizes(marked)


@query("V02_duplication_metrics", f"WITH RECURSIVE {_SIZED} SELECT * FROM sized")
def v02(spark, sf):
    return _sizes(spark, sf)


@query("V02_return_curve", f"""WITH RECURSIVE {_SIZED} SELECT library, t::INT AS times, round(library_size * (1 - exp(-t * pairs / library_size)) / "unique", 6) AS share FROM sized, range(1, 11) r(t) WHERE library_size IS NOT NULL""")
def v02_curve(spark, sf):
    return T.return_curve(_sizes(spark, sf))


@query("V15_with_alignment", """WITH u AS (SELECT order_id, line, qname, is_first, seq FROM reads_v WHERE line = 6), a AS (SELECT qname, is_first, max(struct_pack(mapq := mapq, contig := contig, start := start, cigar := cigar)) AS b FROM reads_v WHERE line <> 6 GROUP BY ALL)
SELECT order_id, line, qname, is_first, seq, b.contig AS contig, b.start AS start, b.mapq AS mapq, b.cigar AS cigar FROM u LEFT JOIN a USING (qname, is_first)""")
def v15_alignment(spark, sf):
    """Reads without an alignment of their own, with the best one of their name and end."""
    rows = _reads(spark, sf)
    best = rows.where("line <> 6").groupBy("qname", "is_first").agg(F.max(F.struct("mapq", "contig", "start", "cigar")).alias("b")).select("qname", "is_first", "b.*")
    return T.with_alignment(rows.where("line = 6").select("order_id", "line", "qname", "is_first", "seq", "contig", "start", "mapq", "cigar"), best)


@query("V16_clean_records", "SELECT order_id, line, flag, CASE WHEN flag & 4 <> 0 THEN 0 ELSE mapq END AS mapq FROM reads_v")
def v16_clean(spark, sf):
    return T.clean(_reads(spark, sf)).select("order_id", "line", "flag", "mapq")


@query("V03_library_complexity", """WITH g AS (SELECT substring(seq, 1, 8) AS prefix, count(*) AS n FROM reads_v GROUP BY ALL) SELECT n AS group_size, count(*) AS n_groups FROM g GROUP BY ALL""")
def v03(spark, sf):
    groups = _reads(spark, sf).groupBy(F.substring("seq", 1, 8).alias("prefix")).agg(F.count("*").alias("group_size"))
    return groups.groupBy("group_size").agg(F.count("*").alias("n_groups"))


@query("V03_tolerant_complexity", """WITH p AS (SELECT substring(seq, 1, 8) AS prefix, count(*) AS n FROM reads_v GROUP BY ALL), w AS (SELECT prefix, n, k, substring(prefix, 1, k::INT - 1) || '_' || substring(prefix, k::INT + 1) AS key FROM p, range(1, 9) t(k)),
low AS (SELECT key, min(prefix) AS low FROM w GROUP BY key), r AS (SELECT prefix, any_value(n) AS n, min(low) AS leader FROM w JOIN low USING (key) GROUP BY prefix), g AS (SELECT leader, sum(n)::BIGINT AS n FROM r GROUP BY leader)
SELECT n AS group_size, count(*) AS n_groups FROM g GROUP BY ALL""")
def v03_tolerant(spark, sf):
    counts = _reads(spark, sf).groupBy(F.substring("seq", 1, 8).alias("prefix")).agg(F.count("*").alias("n"))
    return T.tolerant_groups(counts, 8).groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("n_groups"))


@query("V07_gc_bias", """WITH s AS (SELECT 'chr' || c AS contig, string_agg(translate(md5(c || k::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), '' ORDER BY k) AS seq FROM (VALUES ('A'), ('N'), ('R')) v(c), range(0, 625) t(k) GROUP BY c),
w AS (SELECT contig, k AS w, substring(seq, (k * 100)::INT + 1, 100) AS part FROM s, range(0, 200) t(k)), g AS (SELECT contig, w, floor(length(regexp_replace(part, '[^GC]', '', 'g')) / length(regexp_replace(part, '[^ACGT]', '', 'g')) * 100)::BIGINT AS gc FROM w),
h AS (SELECT contig, start // 100 AS w, count(*) AS starts FROM reads_v GROUP BY ALL) SELECT gc, count(*) AS windows, coalesce(sum(starts), 0)::BIGINT AS starts FROM g LEFT JOIN h USING (contig, w) GROUP BY gc""")
def v07_gc(spark, sf):
    from ..operators import pileup

    letters = F.translate(F.md5(F.concat("c", F.col("k").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    each = spark.createDataFrame([("A",), ("N",), ("R",)], "c string").select("c", F.explode(F.sequence(F.lit(0), F.lit(624))).alias("k")).withColumn("s", letters)
    contigs = each.groupBy(F.concat(F.lit("chr"), "c").alias("contig")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]), "").alias("seq"))
    return T.gc_windows(_reads(spark, sf).select("contig", F.col("start").alias("pos")), pileup.reference_chunks(contigs))


@query("V08_target_metrics", """WITH t AS (SELECT c.contig, c.pos, c.value, EXISTS (SELECT 1 FROM features_v f WHERE f.contig = c.contig AND c.pos BETWEEN f.start AND f."end") AS inside FROM coverage_v c),
h AS (SELECT f.name, count(c.pos) AS n FROM features_v f LEFT JOIN coverage_v c ON f.contig = c.contig AND c.pos BETWEEN f.start AND f."end" GROUP BY f.name)
SELECT sum(value) FILTER (inside)::BIGINT AS on_target, sum(value) FILTER (NOT inside)::BIGINT AS off_target, round(sum(value) FILTER (inside) / sum(value), 9) AS selected, (SELECT count(*) FROM h) AS targets, (SELECT count(*) FROM h WHERE n = 0) AS untouched FROM t""")
def v08_targets(spark, sf):
    return T.target_metrics(view(spark, sf, "coverage_v"), view(spark, sf, "features_v"))


@query("V04_insert_metrics", """WITH r AS (SELECT orientation, abs(insert_size) AS s FROM reads_v WHERE insert_size <> 0), m AS (SELECT orientation, median(s) AS median FROM r GROUP BY ALL),
d AS (SELECT orientation, median(abs(s - median)) AS mad FROM r JOIN m USING (orientation) GROUP BY ALL)
SELECT orientation, any_value(median) AS median, any_value(mad) AS mad, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd FROM r JOIN m USING (orientation) JOIN d USING (orientation) WHERE s <= median + 2 * mad GROUP BY ALL""")
def v04(spark, sf):
    return T.insert_metrics(_reads(spark, sf), 2.0)


@query("V05_alignment_summary", """SELECT CASE WHEN flag & 1 = 0 THEN 'UNPAIRED' WHEN flag & 64 <> 0 THEN 'FIRST' ELSE 'SECOND' END AS category, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS aligned,
  count(*) FILTER (flag & 4 = 0 AND mapq >= 20) AS good, count(*) FILTER (flag & 8 <> 0) AS mate_unmapped, round(avg((flag & 16 = 0)::INT), 6) AS strand_balance FROM reads_v WHERE flag & 256 = 0 GROUP BY ALL""")
def v05(spark, sf):
    return T.alignment_summary(_reads(spark, sf))


@query("V06_coverage_metrics", """WITH d AS (SELECT contig, pos, value FROM coverage_v), g AS (SELECT sum(l) AS size FROM (SELECT contig, max(pos) + 101 AS l FROM d GROUP BY contig)),
v AS (SELECT least(value, 12) AS b, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 0, (SELECT size FROM g) - (SELECT count(*) FROM d)), e AS (SELECT b, unnest(range(0, n::BIGINT)) AS k FROM v)
SELECT count(*) AS size, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS sd, median(b) AS median, round(avg((b >= 1)::INT), 9) AS at_1x, round(avg((b >= 5)::INT), 9) AS at_5x, round(avg((b >= 10)::INT), 9) AS at_10x FROM e""")
def v06(spark, sf):
    rows = view(spark, sf, "coverage_v")
    lengths = rows.groupBy("contig").agg((F.max("pos") + 101).alias("length"))
    return T.coverage_metrics(rows.select("contig", "pos", F.col("value").alias("depth")), lengths, 12)


@query("V07_quality_by_cycle", """WITH e AS (SELECT unnest(range(1, 33)) AS cycle, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS q FROM reads_v)
SELECT cycle::INT AS cycle, round(avg(ascii(substring(q, cycle, 1)) - 33), 6) AS mean_phred, count(*) AS n FROM e GROUP BY ALL""")
def v07(spark, sf):
    return T.quality_by_cycle(_reads(spark, sf))


@query("V07_quality_distribution", "SELECT ascii(q) - 33 AS phred, count(*) AS n FROM (SELECT unnest(string_split(qual, '')) AS q FROM reads_v) GROUP BY ALL")
def v07b(spark, sf):
    return T.quality_distribution(_reads(spark, sf))


@query("V08_locus_function", """WITH l AS (SELECT r.contig, r.start, max(CASE WHEN f.name IS NULL THEN 0 WHEN f.negative IS NULL THEN 1 ELSE 2 END) AS k FROM (SELECT DISTINCT substring(contig, 4, 1) AS contig, start FROM reads_v) r
  LEFT JOIN features_v f ON r.contig = f.contig AND r.start BETWEEN f.start AND f."end" GROUP BY ALL)
SELECT CASE k WHEN 0 THEN 'INTERGENIC' WHEN 1 THEN 'UNSTRANDED' ELSE 'CODING' END AS locus, count(*) AS n FROM l GROUP BY ALL""")
def v08(spark, sf):
    from ..operators import intervals

    places = _reads(spark, sf).select(F.substring("contig", 4, 1).alias("contig"), F.col("start").alias("pos")).distinct()
    kinds = intervals.overlapping(places, view(spark, sf, "features_v")).groupBy("contig", "pos").agg(F.max(F.when(F.col("negative").isNull(), 1).otherwise(2)).alias("k"))
    joined = places.join(kinds, ["contig", "pos"], "left")
    locus = F.when(F.col("k").isNull(), "INTERGENIC").when(F.col("k") == 1, "UNSTRANDED").otherwise("CODING")
    return joined.groupBy(locus.alias("locus")).agg(F.count("*").alias("n"))


#: Transcripts made of the features: two exons with an intron between them, and a coding stretch.
MODELS = """models AS (SELECT name, contig, start, start + size - 1 AS last, coalesce(negative, false) AS negative, start + 2 AS coding_start, start + size - 2 AS coding_end,
  [start, start + 2 * (size // 3)] AS s, [start + size // 3 + 1, start + size] AS e FROM (SELECT *, "end" - start + 10 AS size FROM features_v)),
exon AS (SELECT name, contig, negative, coding_start, coding_end, k, s[k] AS a, e[k] - 1 AS z, CASE k WHEN 1 THEN 0 ELSE e[1] - s[1] END AS before, e[1] - s[1] + e[2] - s[2] AS length FROM models, (SELECT unnest([1, 2]) AS k))"""


def gene_models(spark, sf):
    """The features as lines of a gene table, and read from there."""
    f = view(spark, sf, "features_v").withColumn("size", F.col("end") - F.col("start") + 10)
    third = F.expr("size div 3")
    text = lambda c: c.cast("string")
    start, last = F.col("start"), F.col("start") + F.col("size")
    exon_starts = F.concat(text(start), F.lit(","), text(start + 2 * third), F.lit(","))
    exon_ends = F.concat(text(start + third + 1), F.lit(","), text(last), F.lit(","))
    strand = F.when(F.coalesce("negative", F.lit(False)), "-").otherwise("+")
    return readers.gene_annotation_rows(f.select(F.concat_ws("\t", F.concat(F.lit("g"), "name"), "name", "contig", strand, text(start), text(last), text(start + 2), text(last - 2), F.lit("2"), exon_starts, exon_ends).alias("value")))


@query("V21_gene_annotations", f"""WITH {MODELS} SELECT name, 'g' || name AS gene, contig, start, last AS "end", negative, coding_start, coding_end, s AS exon_starts, e AS exon_ends FROM models""")
def v21_genes(spark, sf):
    return gene_models(spark, sf)


@query("V08_locus_bases", f"""WITH {MODELS}, hit AS (SELECT c.contig, c.pos, any_value(c.value) AS value, max(CASE WHEN x.a IS NULL THEN NULL WHEN c.pos >= x.coding_start AND c.pos < x.coding_end THEN 3 ELSE 2 END) AS k, count(m.name) AS genes
  FROM coverage_v c LEFT JOIN models m ON m.contig = c.contig AND c.pos BETWEEN m.start AND m.last LEFT JOIN exon x ON x.name = m.name AND c.pos BETWEEN x.a AND x.z GROUP BY c.contig, c.pos)
SELECT CASE WHEN k = 3 THEN 'CODING' WHEN k = 2 THEN 'UTR' WHEN genes > 0 THEN 'INTRONIC' ELSE 'INTERGENIC' END AS kind, sum(value)::BIGINT AS bases FROM hit GROUP BY 1""")
def v08_locus_bases(spark, sf):
    return transcripts.locus_bases(view(spark, sf, "coverage_v"), gene_models(spark, sf))


@query("V08_end_bias", f"""WITH {MODELS}, p AS (SELECT name, length, CASE WHEN negative THEN length - 1 - (before + c.pos - a) ELSE before + c.pos - a END AS place, sum(value) AS v FROM coverage_v c JOIN exon x ON x.contig = c.contig AND c.pos BETWEEN x.a AND x.z GROUP BY ALL),
t AS (SELECT name, length, sum(v) AS total, sum(v * v) AS squares, sum(CASE WHEN place < least(5, length) THEN v ELSE 0 END) AS f, sum(CASE WHEN place >= length - least(5, length) THEN v ELSE 0 END) AS l FROM p GROUP BY ALL)
SELECT name, length, total::BIGINT / length AS mean, sqrt((length * squares - total * total)::DOUBLE) / total::BIGINT AS cv, (f * length)::BIGINT / (least(5, length) * total)::BIGINT AS five_prime, (l * length)::BIGINT / (least(5, length) * total)::BIGINT AS three_prime FROM t WHERE total > 0""")
def v08_end_bias(spark, sf):
    return transcripts.end_bias(view(spark, sf, "coverage_v"), gene_models(spark, sf), 5)


@query("V08_capture_bases", """SELECT CASE WHEN EXISTS (SELECT 1 FROM features_v f WHERE f.contig = c.contig AND f.score > 40 AND c.pos BETWEEN f.start AND f."end") THEN 'ON' WHEN EXISTS (SELECT 1 FROM features_v f WHERE f.contig = c.contig AND f.score > 40 AND c.pos BETWEEN f.start - 5 AND f."end" + 5) THEN 'NEAR' ELSE 'OFF' END AS kind, sum(value)::BIGINT AS bases FROM coverage_v c GROUP BY 1""")
def v08_capture(spark, sf):
    return T.capture_bases(view(spark, sf, "coverage_v"), view(spark, sf, "features_v").where("score > 40"), 5)


_TARGETS = """t AS (SELECT f.name, f.contig, f.start, f."end", f."end" - f.start + 1 AS length, coalesce(sum(c.value), 0)::BIGINT AS total FROM features_v f LEFT JOIN coverage_v c ON c.contig = f.contig AND c.pos BETWEEN f.start AND f."end" GROUP BY ALL)"""


@query("V08_target_coverage", f"WITH {_TARGETS} SELECT *, round(total / length, 6) AS mean FROM t")
def v08_target_coverage(spark, sf):
    return T.target_coverage(view(spark, sf, "coverage_v"), view(spark, sf, "features_v"))


@query("V08_evenness", """WITH p AS (SELECT contig, unnest(range(start, "end" + 1)) AS pos FROM features_v), d AS (SELECT coalesce(value, 0)::BIGINT AS v FROM p LEFT JOIN coverage_v USING (contig, pos)),
q AS (SELECT list_sort(list(v))[1 + count(*) // 5] AS p20, count(*) AS bases, avg(v) AS mean FROM d) SELECT bases, round(mean, 6) AS mean, p20, CASE WHEN p20 > 0 THEN round(mean / p20, 6) END AS fold_80 FROM q""")
def v08_evenness(spark, sf):
    return T.evenness(view(spark, sf, "coverage_v"), view(spark, sf, "features_v"))


@query("V08_gc_dropout", f"""WITH {_TARGETS}, g AS (SELECT (length * 7 + start) % 101 AS gc, sum(length) AS length, sum(total) AS total FROM t GROUP BY 1), s AS (SELECT gc, greatest(length / sum(length) OVER () - total / sum(total) OVER (), 0) * 100 AS short FROM g)
SELECT round(coalesce(sum(short) FILTER (gc <= 50), 0), 6) AS at_dropout, round(coalesce(sum(short) FILTER (gc > 50), 0), 6) AS gc_dropout FROM s""")
def v08_gc_dropout(spark, sf):
    rows = T.target_coverage(view(spark, sf, "coverage_v"), view(spark, sf, "features_v"))
    return T.gc_dropout(rows.withColumn("gc", (F.col("length") * 7 + F.col("start")) % 101))


def _two_ends(spark, sf):
    """First and second ends of six letters over two, so that copies and near copies come up."""
    letters = lambda c: F.substring(F.translate(F.md5(F.concat(F.lit("e"), (c % 3000).cast("string")).cast("binary")), "0123456789abcdef", "ACACACACACACACAC"), 1, 6)
    return _reads(spark, sf).select(letters(F.col("start")).alias("first"), letters(F.col("mate_start")).alias("second"))


_END_SQL = "substring(translate(md5('e' || ({} % 3000)), '0123456789abcdef', 'ACACACACACACACAC'), 1, 6)"


@query("V03_pair_complexity", f"""WITH c AS (SELECT {_END_SQL.format("start")} || {_END_SQL.format("mate_start")} AS id, count(*) AS n FROM reads_v GROUP BY 1),
g AS (SELECT id[1:2] || id[7:8] AS k, list(id ORDER BY n DESC, id) AS ids FROM c GROUP BY 1), h AS (SELECT ids, list_reduce(list_transform(ids, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: hamming(k, y[1]) <= 1)) > 0 THEN acc ELSE acc || y END) AS stay FROM g),
m AS (SELECT id, list_filter(stay, lambda k: hamming(k, id) <= 1)[1] AS leader FROM (SELECT stay, unnest(ids) AS id FROM h))
SELECT leader, sum(n)::BIGINT AS n FROM m JOIN c USING (id) GROUP BY leader""")
def v03_pairs(spark, sf):
    return T.pair_complexity(_two_ends(spark, sf), 6, identical=2, rate=0.1)


_CODE = "substring(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16)"


@query("V18_assigned_barcodes", f"""WITH s AS (SELECT n_name AS sample, {_CODE} AS code FROM nation), r AS (SELECT order_id, line, (order_id % 25)::INT AS k, (order_id % 15 + 1)::INT AS p, line % 4 AS m FROM reads_v),
q AS (SELECT order_id, line, CASE m WHEN 0 THEN code WHEN 1 THEN code[1:p - 1] || 'N' || code[p + 1:] WHEN 2 THEN code[1:p - 1] || 'A' || code[p + 1:] ELSE code[1:p - 1] || 'GT' || code[p + 2:] END AS code FROM r JOIN (SELECT n_nationkey AS k, {_CODE} AS code FROM nation) USING (k)),
f AS (SELECT q.code, s.sample, """ + " + ".join(f"(CASE WHEN q.code[{k}] <> s.code[{k}] AND q.code[{k}] <> 'N' THEN 1 ELSE 0 END)" for k in range(1, 17)) + """ AS d FROM (SELECT DISTINCT code FROM q) q, s),
b AS (SELECT code, arg_min(sample, (d, sample)) AS sample, min(d) AS d, list_sort(list(d))[2] AS second FROM f GROUP BY code)
SELECT order_id, line, q.code, CASE WHEN d <= 1 AND second - d >= 1 THEN sample END AS sample, CASE WHEN d <= 1 AND second - d >= 1 THEN d::INT END AS mismatches FROM q JOIN b USING (code)""")
def v18_assigned(spark, sf):
    """Whole codes of sixteen letters, some with a letter unknown or wrong, against the sheet."""
    own = F.substring(F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 16)
    sheet = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("sample"), own.alias("code"))
    rows = _reads(spark, sf).select("order_id", "line", (F.col("order_id") % 25).alias("k"), (F.col("order_id") % 15 + 1).cast("int").alias("p"), (F.col("line") % 4).alias("m")).join(F.broadcast(sheet.drop("sample")), "k")
    put = lambda letters: F.concat(F.substr("code", F.lit(1), F.col("p") - 1), F.lit(letters), F.substr("code", F.col("p") + len(letters), F.lit(16)))
    code = F.when(F.col("m") == 0, F.col("code")).when(F.col("m") == 1, put("N")).when(F.col("m") == 2, put("A")).otherwise(put("GT"))
    return T.assigned_barcodes(rows.select("order_id", "line", code.alias("code")), sheet.select("sample", "code"), 16)


@query("V22_bisulfite_distance", f"""WITH {SHOWN}, r AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'C' ELSE 'G' END AS wt, order_id % 2 = 1 AS negative FROM shown),
m AS (SELECT *, op = 'M' AND seq <> wt AND NOT (CASE WHEN negative THEN wt = 'G' AND seq = 'A' ELSE wt = 'C' AND seq = 'T' END) AS bad FROM r)
SELECT order_id, line, count(*) FILTER (bad) AS mismatches, (count(*) FILTER (bad) + coalesce(sum(length(seq)) FILTER (op = 'I'), 0) + count(*) FILTER (op = 'D'))::BIGINT AS nm FROM m GROUP BY ALL""")
def v22_bisulfite(spark, sf):
    from ..operators import pileup

    rows = _reads(spark, sf)
    chunks = _letters_a(rows).withColumn("seq", F.repeat(F.lit("CG"), F.lit(5_500)))
    return pileup.edit_distance(rows.withColumn("negative", F.col("order_id") % 2 == 1), ["order_id", "line"], chunks, "negative")


@query("V12_record_filters", r"SELECT order_id, line FROM reads_v WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 AND NOT regexp_matches(cigar, '^\d+S$')")
def v12(spark, sf):
    keep = ~R.flagged(R.UNMAPPED) & ~R.flagged(R.SECONDARY) & ~R.flagged(R.SUPPLEMENTARY) & ~F.col("cigar").rlike(r"^\d+S$")
    return _reads(spark, sf).where(keep).select("order_id", "line")


@query("V13_depth", f"""WITH {SHOWN} SELECT contig, pos::INT AS pos, least(count(*), 20) AS depth, greatest(count(*) - 20, 0) AS excluded FROM shown WHERE op = 'M' GROUP BY contig, pos""")
def v13(spark, sf):
    from ..operators import pileup

    return pileup.depth(_reads(spark, sf), 20)


@query("V15_merged_sorted", "SELECT contig, start, line FROM reads_v WHERE line IN (1, 2)")
def v15(spark, sf):
    rows = _reads(spark, sf).select("contig", "start", "line")
    return rows.where("line = 1").unionByName(rows.where("line = 2")).repartitionByRange("contig", "start").sortWithinPartitions("contig", "start")


@query("O05_merged", "SELECT contig, start, line, row_number() OVER (ORDER BY contig, start, line) AS place FROM (SELECT DISTINCT contig, start, line FROM reads_v)")
def o05(spark, sf):
    """Seven sorted files merged into one order."""
    rows = _reads(spark, sf).select("contig", "start", "line").distinct()
    merged = reduce(DataFrame.unionByName, [rows.where(F.col("line") == k) for k in range(1, 8)])
    return numbered(merged, ["contig", "start", "line"])


@query("V16_downsampled", "SELECT qname, line FROM reads_v WHERE flag & 256 = 0 AND flag & 2048 = 0 AND ('0x' || substring(md5('1:' || qname), 1, 8))::BIGINT % 1000000 < 400000")
def v16(spark, sf):
    return T.downsample(_reads(spark, sf), 0.4).select("qname", "line")


@query("V16_compared", """WITH a AS (SELECT order_id, line, max(start) AS start, max(mapq) AS mapq FROM reads_v WHERE line < 5 GROUP BY ALL), b AS (SELECT order_id, line, max(start) AS start, max(mapq) AS mapq FROM reads_v WHERE line > 1 AND n_clipped < 25 GROUP BY ALL)
SELECT CASE WHEN a.order_id IS NULL THEN 'only_second' WHEN b.order_id IS NULL THEN 'only_first' WHEN a.start = b.start AND a.mapq = b.mapq THEN 'match' ELSE 'differ' END AS outcome, count(*) AS n FROM a FULL JOIN b ON a.order_id = b.order_id AND a.line = b.line GROUP BY ALL""")
def v16b(spark, sf):
    rows = _reads(spark, sf)
    best = lambda df: df.groupBy("order_id", "line").agg(F.max("start").alias("start"), F.max("mapq").alias("mapq"))
    return T.compare(best(rows.where("line < 5")), best(rows.where("line > 1 AND n_clipped < 25")), ["order_id", "line"], ["start", "mapq"])


@query("V16_validated", """SELECT 'MAPQ_ON_UNMAPPED' AS problem, count(*) AS n FROM reads_v WHERE flag & 4 <> 0 AND mapq <> 0 HAVING count(*) > 0 UNION ALL
SELECT 'MATE_FLAGS_ON_UNPAIRED', count(*) FROM reads_v WHERE flag & 1 = 0 AND flag & 234 <> 0 HAVING count(*) > 0""")
def v16c(spark, sf):
    return T.validate(_reads(spark, sf))


@query("V17_fastq", f"SELECT qname, flag & 64 <> 0 AS first, '@' || qname || chr(10) || CASE WHEN flag & 16 <> 0 THEN {COMP.format('reverse(seq)')} ELSE seq END || chr(10) || '+' || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS record FROM reads_v WHERE flag & 256 = 0 AND flag & 2048 = 0")
def v17(spark, sf):
    return T.to_fastq(_reads(spark, sf))


@query("V17_reverted", f"SELECT qname, flag & 193 | 4 AS flag, CASE WHEN flag & 16 <> 0 THEN {COMP.format('reverse(seq)')} ELSE seq END AS seq, '*' AS cigar, -1 AS start FROM reads_v WHERE flag & 256 = 0")
def v17b(spark, sf):
    return T.revert(_reads(spark, sf)).select("qname", "flag", "seq", "cigar", "start")


@query("V18_extracted_barcodes", f"SELECT order_id, line, {HAMMING} <= 1 AS matched FROM reads_v")
def v18(spark, sf):
    return _reads(spark, sf).select("order_id", "line", (S.mismatches(F.col("const_bc"), F.substring("seq", 1, 3), 3) <= 1).alias("matched"))


@query("V19_extracted_sequences", """WITH s AS (SELECT c AS contig, string_agg(translate(md5(c || k::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), '' ORDER BY k) AS seq FROM (VALUES ('A'), ('N'), ('R')) v(c), range(0, 700) t(k) GROUP BY c)
SELECT name, substring(seq, start + 1, "end" - start + 1) AS seq FROM features_v f JOIN s USING (contig)""")
def v19(spark, sf):
    from ..operators import pileup

    letters = F.translate(F.md5(F.concat("c", F.col("k").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    each = spark.createDataFrame([("A",), ("N",), ("R",)], "c string").select("c", F.explode(F.sequence(F.lit(0), F.lit(699))).alias("k")).withColumn("s", letters)
    contigs = each.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]), "").alias("seq")).select(F.col("c").alias("contig"), "seq")
    return T.extract_sequences(view(spark, sf, "features_v"), pileup.reference_chunks(contigs, 1000), 1000)


@query("S13_random_positions", "WITH l AS (SELECT contig, max(pos) AS last FROM coverage_v GROUP BY contig), p AS (SELECT contig, unnest(range(0, last + 1)) AS pos FROM l) SELECT contig, pos FROM p WHERE ('0x' || substring(md5('3:' || contig || ':' || pos), 1, 8))::BIGINT % 1000000 < 50000")
def s13(spark, sf):
    lengths = view(spark, sf, "coverage_v").groupBy("contig").agg((F.max("pos") + 1).alias("length"))
    return R.random_positions(lengths, 0.05, seed=3)


@query("A46_barcode_mismatches", f"""WITH {MERGED}, l AS (SELECT k AS place, t.left_bc[k] AS fst, left_bc[k] AS snd FROM merged, (SELECT unnest([1, 2, 3]) AS k) WHERE t.molecule <> molecule)
SELECT place::INT AS place, fst, snd, count(*) AS n FROM l WHERE fst <> snd GROUP BY ALL""")
def a46(spark, sf):
    rows = _single(spark, sf)
    placed = rows.select("sample", "contig", "molecule", *M.ORDER, "n_top", "n_bottom")
    return M.merged_barcode_mismatches(rows, M.fuzzy_merge(placed, 0, 1, ["sample", "contig"], named_once=True), 3)


@query("A49_records", "SELECT contig, count(*) AS n_records, sum(length(seq))::BIGINT AS n_bases FROM reads_v GROUP BY contig")
def a49(spark, sf):
    return _reads(spark, sf).groupBy("contig").agg(F.count("*").alias("n_records"), F.sum(F.length("seq")).alias("n_bases"))


@query("V16_filtered_names", "SELECT qname, line FROM reads_v WHERE qname NOT IN (SELECT qname FROM reads_v WHERE line = 1)")
def v16d(spark, sf):
    rows = _reads(spark, sf)
    return T.filter_names(rows, rows.where("line = 1"), include=False).select("qname", "line")


@query("V15_reordered", "SELECT contig, start, line FROM reads_v WHERE contig IN ('chrR', 'chrA')")
def v15b(spark, sf):
    order = spark.createDataFrame([("chrR", 0), ("chrA", 1)], "contig string, place int")
    return T.reordered(_reads(spark, sf), order).select("contig", "start", "line")


@query("V15_fixed_mates", f"WITH {ONE} SELECT a.order_id, a.is_first, m.start AS mate_start FROM one a LEFT JOIN one m ON a.order_id = m.order_id AND a.is_first <> m.is_first")
def v15c(spark, sf):
    rows = _reads(spark, sf).select("order_id", "is_first", "start", "mapq", "cigar", "mate_start")
    return T.fixed_mates(rows, ["order_id"]).select("order_id", "is_first", "mate_start")


@query("V17_read_groups", "SELECT order_id, line, line::VARCHAR AS dq, 'g1' AS rg FROM reads_v")
def v17c(spark, sf):
    rows = _reads(spark, sf).withColumn("tags", F.create_map(F.lit("DQ"), F.col("line").cast("string"), F.lit("RG"), F.lit("old")))
    made = T.with_read_group(rows, "g1")
    return made.select("order_id", "line", F.col("tags")["DQ"].alias("dq"), F.col("tags")["RG"].alias("rg"))
