"""Queries over positions, intervals and position arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import table
from ..standins import view
from .registry import query


def _features(spark, sf):
    return view(spark, sf, "features_v")


def _coverage(spark, sf):
    return view(spark, sf, "coverage_v")


def _two_sets(spark, sf):
    rows = _features(spark, sf)
    return tuple(rows.where(F.col("score") % 2 == k).select("contig", F.col("start") * 7, F.col("start") * 7 + F.col("score")).toDF("contig", "start", "end") for k in (0, 1))


ON = "f.contig = c.contig AND c.pos BETWEEN f.start AND f.\"end\""
SETS = """places AS (SELECT contig, start * 7 AS start, start * 7 + score AS "end", score % 2 AS side FROM features_v),
inside AS (SELECT DISTINCT contig, side, unnest(range(start, "end" + 1)) AS pos FROM places),
flags AS (SELECT contig, pos, max(side = 0) AS in_a, max(side = 1) AS in_b FROM inside GROUP BY ALL)"""


def _islands(condition: str) -> str:
    return f"""WITH {SETS}, k AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM flags WHERE {condition})
SELECT contig, min(pos) AS start, max(pos) AS "end" FROM k GROUP BY contig, g"""


@query("J04_inside_features", f"SELECT c.* FROM coverage_v c WHERE EXISTS (SELECT 1 FROM features_v f WHERE {ON})")
def j04(spark, sf):
    return I.inside(_coverage(spark, sf), _features(spark, sf))


@query("J05_outside_features", f"SELECT c.* FROM coverage_v c WHERE NOT EXISTS (SELECT 1 FROM features_v f WHERE {ON} AND score > 40)")
def j05(spark, sf):
    return I.outside(_coverage(spark, sf), _features(spark, sf).where("score > 40"))


@query("F15_exclude_positions", f"SELECT c.* FROM coverage_v c WHERE NOT EXISTS (SELECT 1 FROM features_v f WHERE {ON} AND score > 30)")
def f15(spark, sf):
    return I.outside(_coverage(spark, sf), _features(spark, sf).where("score > 30"))


@query("J06_overlapping_features", f"SELECT c.contig, c.pos, c.value, f.name FROM coverage_v c JOIN features_v f ON {ON}")
def j06(spark, sf):
    return I.overlapping(_coverage(spark, sf), _features(spark, sf)).select("contig", "pos", "value", "name")


@query("J07_gene_strand", f"""SELECT c.contig, c.pos, c.value, CASE WHEN bool_and(f.negative) = bool_or(f.negative) THEN bool_or(f.negative) END AS negative
  FROM coverage_v c LEFT JOIN features_v f ON {ON} GROUP BY ALL""")
def j07(spark, sf):
    return I.gene_strand(_coverage(spark, sf), _features(spark, sf))


#: All features, made one within each 51 places, so that none overlap.
APART = """SELECT contig, min(name) AS name, min(start) AS start, least(max("end"), floor(start / 51) * 51 + 50) AS "end" FROM features_v GROUP BY contig, floor(start / 51)"""


@query("J08_single_feature", f"""SELECT c.contig, c.pos, any_value(f.name) AS name FROM coverage_v c JOIN ({APART}) f ON {ON} GROUP BY ALL""")
def j08(spark, sf):
    k = F.floor(F.col("start") / 51)
    apart = _features(spark, sf).groupBy("contig", k.alias("k")).agg(F.min("name").alias("name"), F.min("start").alias("start"), F.max("end").alias("end"))
    return I.single_feature(_coverage(spark, sf), apart.withColumn("end", F.least("end", F.col("k") * 51 + 50)))


@query("J16_feature_names", "SELECT f.name, p.p_name AS gene FROM features_v f LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON f.name = 'f' || p.p_partkey")
def j16(spark, sf):
    names = table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("gene"))
    return _features(spark, sf).select("name").join(names, "name", "left")


@query("J17_score_sums", f"SELECT c.contig, c.pos, c.value, coalesce(sum(f.score), -1)::BIGINT AS score FROM coverage_v c LEFT JOIN features_v f ON {ON} GROUP BY ALL")
def j17(spark, sf):
    return I.score_sums(_coverage(spark, sf), _features(spark, sf))


@query("J21_touched_features", f"""SELECT f.name, f.contig, f.start, f."end", count(DISTINCT c.pos) AS n_hits FROM features_v f JOIN (SELECT * FROM coverage_v WHERE value > 12) c ON {ON} GROUP BY ALL""")
def j21(spark, sf):
    return I.touched(_features(spark, sf), _coverage(spark, sf).where("value > 12"))


@query("A44_select_intervals", f"""WITH t AS (SELECT DISTINCT f.* FROM features_v f JOIN (SELECT * FROM coverage_v WHERE value > 14) c ON {ON})
SELECT count(DISTINCT (c.contig, c.pos)) AS covered FROM coverage_v c JOIN t f ON {ON}""")
def a44(spark, sf):
    chosen = I.touched(_features(spark, sf), _coverage(spark, sf).where("value > 14"))
    return I.inside(_coverage(spark, sf).select("contig", "pos"), chosen).agg(F.count("*").alias("covered"))


@query("J22_sum_of_arrays", "SELECT contig, pos, (3 * value + 1)::BIGINT AS value FROM coverage_v")
def j22(spark, sf):
    rows = _coverage(spark, sf)
    return I.sum_arrays([rows, rows.withColumn("value", F.col("value") + 1), rows])


@query("A45_sum_arrays", "SELECT contig, (2 * sum(value))::BIGINT AS value FROM coverage_v GROUP BY contig")
def a45(spark, sf):
    rows = _coverage(spark, sf)
    return I.sum_arrays([rows, rows]).groupBy("contig").agg(F.sum("value").alias("value"))


@query("A34_feature_breakdown", f"""WITH s AS (SELECT f.name, f."end" - f.start + 1 AS length, coalesce(sum(c.value), 0)::BIGINT AS raw FROM features_v f LEFT JOIN coverage_v c ON {ON} GROUP BY ALL)
SELECT name, length, raw, round(raw / length, 6) AS normalised, round(raw / length * 1e6 / (SELECT sum(raw / length) FROM s), 4) AS tpm FROM s""")
def a34(spark, sf):
    return I.feature_breakdown(_coverage(spark, sf), _features(spark, sf))


@query("A35_normalised_coverage", f"""WITH r AS (SELECT f.name, c.contig, c.pos, c.value FROM coverage_v c JOIN features_v f ON {ON}),
s AS (SELECT name, avg(value) AS m, list_sort(list(value)) AS v, count(*) AS n FROM r GROUP BY name)
SELECT name, contig, pos, round(value / m, 6) AS over_mean, round(value / v[floor(n * 0.8)::INT + 1], 6) AS over_p80, round(value / v[floor(n * 0.95)::INT + 1], 6) AS over_p95 FROM r JOIN s USING (name)""")
def a35(spark, sf):
    return I.normalised_coverage(_coverage(spark, sf), _features(spark, sf))


@query("A41_dense_histogram", "SELECT b AS bin, count(value) AS n FROM (SELECT unnest(range(0, 41)) AS b) LEFT JOIN coverage_v ON value = b GROUP BY b")
def a41(spark, sf):
    return I.dense_histogram(_coverage(spark, sf), 40)


@query("A42_threshold_runs", """WITH k AS (SELECT contig, pos, value, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM coverage_v WHERE value >= 10)
SELECT contig, min(pos) AS start, max(pos) AS "end", arg_max(value, pos) AS last_value FROM k GROUP BY contig, g""")
def a42(spark, sf):
    return I.threshold_runs(_coverage(spark, sf), 10)


@query("A43_moving_average", """WITH RECURSIVE o AS (SELECT contig, pos, value, row_number() OVER (PARTITION BY contig ORDER BY pos) AS k FROM coverage_v),
e AS (SELECT contig, pos, k, CASE WHEN value >= 8 THEN 0.1::DOUBLE * value ELSE 0::DOUBLE END AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.contig, o.pos, o.k, CASE WHEN value >= 8 THEN 0.1::DOUBLE * value + 0.9::DOUBLE * ema ELSE ema END FROM e JOIN o ON o.contig = e.contig AND o.k = e.k + 1)
SELECT contig, pos, round(ema, 6) AS ema FROM e WHERE k % 11 = 0""")
def a43(spark, sf):
    rows = I.moving_average(_coverage(spark, sf), 0.1, 10, threshold=8)
    return rows.withColumn("ema", F.round("ema", 6))


@query("U02_union", _islands("true"))
def u02_union(spark, sf):
    a, b = _two_sets(spark, sf)
    return I.merge(a.unionByName(b))


@query("U02_intersect", _islands("in_a AND in_b"))
def u02_intersect(spark, sf):
    return I.intersect(*_two_sets(spark, sf))


@query("U02_subtract", _islands("in_a AND NOT in_b"))
def u02_subtract(spark, sf):
    return I.subtract(*_two_sets(spark, sf))


@query("U02_symmetric_difference", _islands("in_a <> in_b"))
def u02_symmetric(spark, sf):
    return I.symmetric_difference(*_two_sets(spark, sf))


@query("U02_invert", f"""WITH {SETS}, l AS (SELECT contig, max("end") + 11 AS length FROM places WHERE side = 0 GROUP BY contig),
free AS (SELECT contig, unnest(range(0, length)) AS pos FROM l EXCEPT SELECT contig, pos FROM flags WHERE in_a),
k AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM free)
SELECT contig, min(pos) AS start, max(pos) AS "end" FROM k GROUP BY contig, g""")
def u02_invert(spark, sf):
    a, _ = _two_sets(spark, sf)
    return I.invert(a, a.groupBy("contig").agg((F.max("end") + 11).alias("length")))


@query("U02_pad_scatter", """WITH p AS (SELECT name, contig, greatest(start - 3, 0) AS s, "end" + 5 AS e FROM features_v),
c AS (SELECT *, unnest(range(s // 20, e // 20 + 1)) AS k FROM p) SELECT name, contig, greatest(s, k * 20) AS start, least(e, k * 20 + 19) AS "end" FROM c""")
def u02_scatter(spark, sf):
    return I.scatter(I.pad(_features(spark, sf).select("name", "contig", "start", "end"), 3, 5), 20)


@query("V11_overlaps", """SELECT a.name AS a, b.name AS b FROM features_v a JOIN features_v b ON a.contig = b.contig AND a.start BETWEEN b.start AND b."end" WHERE a.name <> b.name""")
def v11(spark, sf):
    rows = _features(spark, sf)
    starts = rows.select(F.col("name").alias("a"), "contig", F.col("start").alias("pos"))
    return I.overlapping(starts, rows.select(F.col("name").alias("b"), "contig", "start", "end")).where("a <> b").select("a", "b")


@query("V14_lift_over", """WITH ks AS (SELECT DISTINCT p_partkey // 40 AS k FROM part),
ch AS (SELECT k % 4 AS chain, substring('ANR', (k % 3)::INT + 1, 1) AS contig, k * 40 AS start, k * 40 + 39 AS "end", 'to' || (k % 2) AS to_contig, k * 80 AS to_start FROM ks),
m AS (SELECT f.name, chain, to_contig, sum(least(f."end", ch."end") - greatest(f.start, ch.start) + 1) AS covered, min(to_start + greatest(f.start, ch.start) - ch.start) AS new_start,
  max(to_start + least(f."end", ch."end") - ch.start) AS new_end, any_value(f."end" - f.start + 1) AS len FROM features_v f JOIN ch ON f.contig = ch.contig AND f.start <= ch."end" AND ch.start <= f."end" GROUP BY f.name, chain, to_contig HAVING covered >= 0.95 * len),
o AS (SELECT name, any_value(to_contig) AS to_contig, any_value(new_start) AS new_start, any_value(new_end) AS new_end FROM m GROUP BY name HAVING count(*) = 1)
SELECT f.name, to_contig, new_start, new_end FROM features_v f LEFT JOIN o USING (name)""")
def v14(spark, sf):
    k = F.col("k")
    chains = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("k")).distinct().select(
        (k % 4).alias("chain"), F.expr("substring('ANR', CAST(k % 3 AS INT) + 1, 1)").alias("contig"), (k * 40).alias("start"),
        (k * 40 + 39).alias("end"), F.concat(F.lit("to"), (k % 2).cast("string")).alias("to_contig"), (k * 80).alias("to_start"),
    )
    return I.lift_over(_features(spark, sf), chains)


@query("K12_feature_coverage", f"""SELECT f.name, coalesce(sum(c.value), 0)::BIGINT AS raw FROM features_v f LEFT JOIN coverage_v c ON {ON} GROUP BY f.name""")
def k12(spark, sf):
    return I.feature_breakdown(_coverage(spark, sf), _features(spark, sf)).select("name", "raw")


@query("W07_running_depth", """WITH e AS (SELECT contig, at_pos, sum(d)::BIGINT AS d FROM (SELECT contig, start AS at_pos, 1 AS d FROM features_v UNION ALL SELECT contig, "end" + 1, -1 FROM features_v) GROUP BY ALL)
SELECT contig, at_pos, (sum(d) OVER (PARTITION BY contig ORDER BY at_pos))::BIGINT AS depth, lead(at_pos) OVER (PARTITION BY contig ORDER BY at_pos) AS next_at FROM e""")
def w07(spark, sf):
    f = _features(spark, sf)
    edges = f.select("contig", F.col("start").alias("at_pos"), F.lit(1).alias("d")).union(f.select("contig", F.col("end") + 1, F.lit(-1)))
    steps = edges.groupBy("contig", "at_pos").agg(F.sum("d").alias("d"))
    return I.running(steps, "at_pos", ["d"], stretch=100).select("contig", "at_pos", F.col("run_d").alias("depth"), "next_at")


@query("P02_feature_testers", f"SELECT c.contig, c.pos, EXISTS (SELECT 1 FROM features_v f WHERE {ON}) AS inside FROM coverage_v c")
def p02(spark, sf):
    rows = _coverage(spark, sf)
    hits = I.inside(rows.select("contig", "pos"), _features(spark, sf)).withColumn("inside", F.lit(True))
    return rows.join(hits, ["contig", "pos"], "left").select("contig", "pos", F.coalesce("inside", F.lit(False)).alias("inside"))
