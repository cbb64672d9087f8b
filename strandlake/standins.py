"""Stand-in views: the general tables seen as bases, reads, intervals and molecules.

Reads need files that the general tables don't have, so every operator is also run over these views,
whose SQL text is the same in Spark and in DuckDB. Only integers, strings and booleans are made, so
no rounding differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import table

#: One observed base a row: samples A, N, R; strands F (top) and O (bottom); three molecules a place. Each
#: position stands on two contigs and has a half place; alleles are changes of all kinds.
BASES = """
SELECT l_returnflag AS sample, l_linestatus AS strand, concat('c', CAST(l_partkey % 2 + 1 AS STRING)) AS contig,
  CAST(floor(l_partkey / 4) AS BIGINT) AS pos, l_partkey % 4 >= 2 AS half, l_suppkey % 3 AS dup,
  CASE WHEN l_linenumber <> 7 THEN 'A' WHEN l_partkey % 4 >= 2 THEN '^TC^' WHEN l_partkey % 12 = 1 THEN '-A-' ELSE 'T' END AS allele,
  CAST(l_quantity AS INT) AS phred,
  CAST(l_suppkey % 45 AS INT) AS lig_dist, CAST(l_orderkey % 61 AS INT) AS mapq,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 61 AS INT) END AS mate_mapq,
  CAST(l_orderkey % 900 + 100 AS INT) AS insert_size, l_linenumber = 6 AS wrong_pair,
  CAST(floor(l_partkey / 4) AS BIGINT) - l_suppkey % 7 AS left_start, CAST(floor(l_partkey / 4) AS BIGINT) + 100 + l_suppkey % 11 AS right_end
FROM lineitem
"""

#: Aligned reads; names hold tile, coordinates and barcodes.
READS = """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS INT) AS line,
  concat('M1:7:FC:', CAST(l_suppkey % 4 AS STRING), ':', CAST(1101 + l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING),
    '_BC:Z:', substring(translate(md5(CAST(l_partkey % 97 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 7)) AS qname,
  CAST(CASE WHEN l_linenumber = 6 THEN 0 ELSE 1 END + CASE WHEN l_quantity = 1 THEN 4 ELSE 0 END + CASE WHEN l_quantity = 2 AND l_linenumber <> 6 THEN 8 ELSE 0 END
    + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 AND l_linenumber <> 6 THEN 64 ELSE 0 END
    + CASE WHEN l_quantity = 3 THEN 256 ELSE 0 END + CASE WHEN l_quantity = 4 THEN 2048 ELSE 0 END AS INT) AS flag,
  CASE WHEN l_suppkey % 11 = 0 THEN 'chrUn_7' ELSE concat('chr', l_returnflag) END AS contig,
  CASE WHEN l_suppkey % 13 = 0 THEN 'chrM' WHEN l_suppkey % 11 = 0 THEN 'chrUn_7' ELSE concat('chr', l_returnflag) END AS mate_contig,
  CAST(l_partkey AS INT) AS start, CAST(l_partkey + l_suppkey % 300 AS INT) AS mate_start,
  CAST(l_orderkey % 61 AS INT) AS mapq, CAST((l_suppkey % 25) * 60 - 240 AS INT) AS insert_size,
  CASE l_linenumber % 5 WHEN 0 THEN '32M' WHEN 1 THEN '5S27M' WHEN 2 THEN '12M3D20M' WHEN 3 THEN '10M2I16M4S' ELSE '8M100N20M4S' END AS cigar,
  translate(md5(CAST(l_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq,
  translate(md5(CAST(l_suppkey AS STRING)), '0123456789abcdef', '#+05:?DEFGHI5:?@') AS qual,
  substring(translate(md5(CAST(l_suppkey % 50 AS STRING)), '0123456789abcdef', 'ACGTACGTTTCCTTCN'), 1, 3) AS const_bc,
  l_linestatus = 'F' AS negative, l_linenumber % 2 = 1 AS is_first,
  CASE WHEN l_suppkey % 5 = 0 THEN 'TANDEM' WHEN l_suppkey % 5 = 1 THEN 'RF' ELSE 'FR' END AS orientation,
  l_suppkey % 13 = 0 AS wrong_pair, CAST(l_suppkey % 30 AS INT) AS n_clipped, CAST(l_suppkey % 42 AS INT) AS median_phred
FROM lineitem
"""

#: Features on three contigs, with a strand where there is one.
FEATURES = """
SELECT concat('f', CAST(p_partkey AS STRING)) AS name, substring('ANR', CAST(p_partkey % 3 AS INT) + 1, 1) AS contig,
  p_partkey AS start, p_partkey + p_size AS "end", CAST(p_size AS BIGINT) AS score,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_partkey % 2 = 1 END AS negative
FROM part
"""

#: Positions with a value.
COVERAGE = "SELECT l_returnflag AS contig, l_partkey AS pos, count(*) AS value FROM lineitem GROUP BY l_returnflag, l_partkey"

#: Molecules with both ends and two barcodes.
MOLECULES = """
SELECT l_returnflag AS sample, concat('c', CAST(l_suppkey % 2 + 1 AS STRING)) AS contig, l_orderkey * 10 + l_linenumber AS molecule, l_partkey AS left_start, l_partkey + 100 + l_suppkey % 40 AS right_end,
  substring(translate(md5(CAST(l_suppkey % 9 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 3) AS left_bc,
  substring(translate(md5(CAST(l_partkey % 7 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 3) AS right_bc,
  concat('q', CAST(l_orderkey % 5000 AS STRING)) AS qname, CAST(l_orderkey % 900 - 100 AS INT) AS insert_size, CAST(l_suppkey % 30 AS INT) AS n_clipped,
  l_linestatus AS strand, l_linenumber % 2 = 1 AS negative, l_linenumber = 6 AS wrong_pair,
  CAST(l_quantity AS BIGINT) AS n_top, CAST(l_suppkey % 5 AS BIGINT) AS n_bottom
FROM lineitem
"""

TEXTS = {"bases_v": BASES, "reads_v": READS, "features_v": FEATURES, "coverage_v": COVERAGE, "molecules_v": MOLECULES}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame."""
    text = TEXTS[name].replace('"end"', "`end`")
    for source in ("lineitem", "part"):
        if f"FROM {source}" in text:
            return spark.sql(text.replace(f"FROM {source}", "FROM {t}"), t=table(spark, sf_dir, source))
    raise KeyError(name)


def with_views(sql: str) -> str:
    """`sql` for DuckDB, with the stand-in views that it names in front."""
    used = [f"{n} AS ({t})" for n, t in TEXTS.items() if n in sql]
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(used)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(used)}, {body[5:]}"
    return f"WITH {', '.join(used)} {body}"
