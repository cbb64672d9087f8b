"""Queries of counters and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..session import table
from ..standins import view
from .registry import query


@query("A29_nested_counter", """SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity)::BIGINT AS total, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def a29(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_quantity").cast("long").alias("q"))
    return S.counter(rows, ["a", "b"], F.col("q"))


@query("A30_predicate_counters", """SELECT 'All' AS predicate, sum(value)::BIGINT AS total FROM coverage_v UNION ALL SELECT 'A', sum(value)::BIGINT FROM coverage_v WHERE contig = 'A'
  UNION ALL SELECT 'low', sum(value)::BIGINT FROM coverage_v WHERE pos < 100 UNION ALL SELECT 'not low', sum(value)::BIGINT FROM coverage_v WHERE pos >= 100""")
def a30(spark, sf):
    low = F.col("pos") < 100
    return S.by_predicate(view(spark, sf, "coverage_v"), {"All": F.lit(True), "A": F.col("contig") == "A", "low": low, "not low": ~low}, F.col("value"))


@query("A31_contig_bins", "SELECT contig, pos // 250 AS bin, sum(value)::BIGINT AS total, (grouping(contig) * 2 + grouping(pos // 250))::BIGINT AS level FROM coverage_v GROUP BY ROLLUP (contig, pos // 250)")
def a31(spark, sf):
    return S.by_contig_bin(view(spark, sf, "coverage_v"), 250, F.col("value"))


@query("A32_clamped_histogram", "SELECT least(value, 14) AS bin, count(*) AS n FROM coverage_v GROUP BY ALL")
def a32(spark, sf):
    return S.histogram(view(spark, sf, "coverage_v"), "value", 15)


@query("W08_histogram_median", """WITH h AS (SELECT least(value, 14) AS bin, count(*) AS n FROM coverage_v GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS all_n FROM h)
SELECT (SELECT count(*) FROM coverage_v) AS n, (SELECT round(avg(value), 6) FROM coverage_v) AS average, min(bin) FILTER (2 * upto >= all_n) AS median, max(bin) = 14 AS underestimate FROM c""")
def w08(spark, sf):
    return S.histogram_summary(view(spark, sf, "coverage_v"), "value", 15)


@query("A33_histogram_sum", "SELECT bin, sum(n)::BIGINT AS n FROM (SELECT least(value, 9) AS bin, count(*) AS n FROM coverage_v GROUP BY ALL UNION ALL SELECT least(value, 14), count(*) FROM coverage_v GROUP BY ALL) GROUP BY bin")
def a33(spark, sf):
    rows = view(spark, sf, "coverage_v")
    return S.histogram_sum([S.histogram(rows, "value", 10), S.histogram(rows, "value", 15)])


@query("V10_histogram_statistics", """WITH m AS (SELECT median(value) AS med FROM coverage_v), q AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM coverage_v)
SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, (SELECT arg_max(value, n * 1000 - value) FROM (SELECT value, count(*) AS n FROM coverage_v GROUP BY ALL)) AS mode, any_value(med) AS median,
  any_value(v[ceil(n * 0.1)::INT]) AS p10, any_value(v[ceil(n * 0.9)::INT]) AS p90, median(abs(value - med)) AS mad, round(median(abs(value - med)) * 1.4826, 6) AS sd_estimate FROM coverage_v, m, q""")
def v10(spark, sf):
    counts = view(spark, sf, "coverage_v").groupBy(F.col("value").alias("bin")).agg(F.count("*").alias("n"))
    return S.histogram_statistics(counts)


@query("A50_top_barcodes", "SELECT left_bc, count(*) AS hits FROM molecules_v GROUP BY ALL ORDER BY hits DESC, left_bc LIMIT 5")
def a50(spark, sf):
    return S.top_values(view(spark, sf, "molecules_v"), "left_bc", 5)


@query("V09_multi_level", """SELECT contig, flag % 2 AS paired, count(*) AS n, sum(mapq)::BIGINT AS mapq_sum, (grouping(contig) * 2 + grouping(flag % 2))::BIGINT AS level FROM reads_v GROUP BY GROUPING SETS ((contig, flag % 2), (contig), ())""")
def v09(spark, sf):
    from ..operators import toolkit

    rows = view(spark, sf, "reads_v").withColumn("paired", F.col("flag") % 2)
    return toolkit.multi_level(rows, [["contig", "paired"], ["contig"], []], ["contig", "paired"])


@query("P01_named_predicates", "SELECT 'covered' AS predicate, count(*) AS total FROM coverage_v WHERE value > 5 UNION ALL SELECT 'first contig', count(*) FROM coverage_v WHERE contig = 'A'")
def p01(spark, sf):
    return S.by_predicate(view(spark, sf, "coverage_v"), {"covered": F.col("value") > 5, "first contig": F.col("contig") == "A"}, F.lit(1))


@query("P05_printed_keys", "SELECT contig, 'bin ' || (pos // 250) || CASE WHEN value > 9 THEN '+' ELSE '' END AS bin, count(*) AS n FROM coverage_v GROUP BY ALL")
def p05(spark, sf):
    """Counter keys in a form of one's own, with a mark beside the bin."""
    rows = view(spark, sf, "coverage_v").select("contig", F.struct(F.floor(F.col("pos") / 250).alias("bin"), (F.col("value") > 9).alias("deep")).alias("bin"))
    text = F.concat(F.lit("bin "), F.col("bin.bin").cast("string"), F.when(F.col("bin.deep"), "+").otherwise(""))
    return S.printed(S.spectrum(rows, ["contig", "bin"]), {"bin": text})
