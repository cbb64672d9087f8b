"""Counters, histograms and spectra: table-driven aggregates over rows that other operators make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Nested counter with subtotals: a rollup over its keys."""
    return rows.rollup(*keys).agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))


def by_predicate(rows: DataFrame, predicates: dict[str, Column], value: Column) -> DataFrame:
    """One counter for each named predicate; a row counts in each one that holds for it."""
    names = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]), lambda n: n.isNotNull())
    return rows.withColumn("predicate", F.explode(names)).groupBy("predicate").agg(F.sum(value).alias("total"))


def by_contig_bin(rows: DataFrame, length: int, value: Column) -> DataFrame:
    """Totals by contig and bin of positions, with contigs' and the overall total."""
    return rows.withColumn("bin", F.floor(F.col("pos") / length)).rollup("contig", "bin").agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of values, all from bins - 1 on in the last bin."""
    return rows.groupBy(F.least(F.col(value), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_summary(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """n, average of unclamped values, median bin (first to reach half) and whether it is clamped."""
    counts = rows.groupBy(F.least(F.col(value), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    upto = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = counts.withColumns({"upto": upto, "all": F.sum("n").over(every)})
    return marked.agg(
        F.sum("n").alias("n"),
        F.round(F.sum("s") / F.sum("n"), 6).alias("average"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bin"))).alias("median"),
        (F.max("bin") == bins - 1).alias("underestimate"),
    )


def histogram_sum(parts: list[DataFrame]) -> DataFrame:
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first.groupBy("bin").agg(F.sum("n").alias("n"))


def histogram_statistics(counts: DataFrame, shares: tuple[float, ...] = (0.1, 0.9)) -> DataFrame:
    """Mean, sd, mode, median (middle two averaged), MAD and percentiles of (bin, n) counts.

    Counts have one row a bin, so the windows hold a histogram, not the data.
    """
    order = Window.orderBy("bin")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = counts.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(every)})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    pick = lambda k: F.min(F.when(F.col("upto") > k, F.col("bin"))).over(every)
    c = c.withColumn("median", (pick(low) + pick(high)) / 2)
    deviation = c.groupBy(F.abs(F.col("bin") - F.col("median")).alias("dev")).agg(F.sum("n").alias("n"))
    by_dev = Window.orderBy("dev")
    all_dev = by_dev.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = deviation.withColumns({"upto": F.sum("n").over(by_dev.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(all_dev)})
    of = lambda k: F.min(F.when(F.col("upto") > k, F.col("dev")))
    mad = d.agg(((of(F.floor((F.col("total") - 1) / 2)) + of(F.floor(F.col("total") / 2))) / 2).alias("mad"))
    mean = F.sum(F.col("bin") * F.col("n")) / F.sum("n")
    spread = F.sqrt((F.sum(F.col("bin") * F.col("bin") * F.col("n")) - F.sum(F.col("bin") * F.col("n")) * F.sum(F.col("bin") * F.col("n")) / F.sum("n")) / (F.sum("n") - 1))
    main = c.agg(
        F.round(mean, 6).alias("mean"),
        F.round(spread, 6).alias("sd"),
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode"),
        F.first("median").alias("median"),
        *[F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("bin"))).alias(f"p{round(100 * p)}") for p in shares],
    )
    return main.join(F.broadcast(mad)).withColumn("sd_estimate", F.round(F.col("mad") * 1.4826, 6))


def spectrum(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def printed(counts: DataFrame, printers: dict[str, Column]) -> DataFrame:
    """Counts with keys replaced by their printed form; keys that print alike are added up."""
    rows = counts.withColumns({k: p.cast("string") for k, p in printers.items()})
    return rows.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def substitution_spectrum(changes: DataFrame) -> DataFrame:
    """Counts of (fst, snd) with zero for those of the twelve substitutions that are missing."""
    letters = [(a, b) for a in "ACGT" for b in "ACGT" if a != b]
    dimension = changes.sparkSession.createDataFrame(letters, "fst string, snd string")
    return F.broadcast(dimension).join(spectrum(changes, ["fst", "snd"]), ["fst", "snd"], "left").fillna(0, ["n"])


def frequency_pairs(tops: DataFrame) -> DataFrame:
    """Counts of top and second frequency in tenths; 99 for a missing one."""
    tenth = lambda c: F.coalesce(F.floor(F.col(c) * 10).cast("int"), F.lit(99))
    return tops.groupBy(tenth("top_freq").alias("top"), tenth("second_freq").alias("second")).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, key: str, n: int = 100) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), key).limit(n)


def first_values(rows: DataFrame, keys: list[str], value: str, most: int, distinct: bool = False, name: str = "values") -> DataFrame:
    """The smallest `most` values of each key, in order, as `name`; only that many of a key are ever brought together."""
    each = rows.select(*keys, F.col(value).alias("__value"))
    each = each.distinct() if distinct else each
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__value"))
    kept = each.withColumn("__rank", rank).where(F.col("__rank") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__value"))), lambda v: v["__value"]).alias(name))
