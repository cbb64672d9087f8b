"""Interval joins and interval algebra, by bins and islands.

Positions and intervals are closed on both ends. An interval is put into every bin that it touches;
joins are equi-joins on (contig, level, bin) with an exact condition beside, so Spark can hash, sort
or broadcast them and split skewed bins; none becomes a nested loop. Long intervals go to wider bins:
each level's bins are WIDER times those of the one below, and an interval touches two bins at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64
WIDER = 16
LEVELS = 7
#: Places of a contig that one task orders.
STRETCH = 1 << 16


def _level(length: Column) -> Column:
    """Least level whose bins of BIN * WIDER^level places an interval of `length` spans twice at most."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS)):
        level = F.when(length <= BIN * WIDER**k, k).otherwise(level)
    return level


def _width(level: Column) -> Column:
    return (F.lit(BIN) * F.pow(F.lit(WIDER), level)).cast("long")


def _binned(intervals: DataFrame) -> DataFrame:
    level = _level(F.col("end") - F.col("start") + 1)
    rows = intervals.withColumn("level", level)
    width = _width(F.col("level"))
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def _probes(positions: DataFrame, pos: str, levels: list[int]) -> DataFrame:
    bins = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(pos) / (BIN * WIDER**k)).alias("bin")) for k in levels])
    return positions.withColumn("b", F.explode(bins)).withColumns({"level": F.col("b.level"), "bin": F.col("b.bin")}).drop("b")


def overlapping(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    """Every position with every interval that holds it (contig, start, end and more of the interval).

    Positions look into the levels that the intervals have. Neither side is broadcast: both have more rows
    here than Spark guesses from their files.
    """
    found = intervals.agg(F.array_sort(F.collect_set(_level(F.col("end") - F.col("start") + 1))).alias("levels")).first()["levels"]
    joined = _probes(positions, pos, found or [0]).hint("merge").join(_binned(intervals), ["contig", "level", "bin"])
    return joined.where(F.col(pos).between(F.col("start"), F.col("end"))).drop("level", "bin")


def _hits(positions: DataFrame, intervals: DataFrame, pos: str) -> DataFrame:
    places = positions.select("contig", pos).distinct()
    return overlapping(places, intervals.select("contig", "start", "end"), pos).select("contig", pos).distinct()


def inside(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    return positions.join(_hits(positions, intervals, pos), ["contig", pos], "left_semi")


def outside(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    return positions.join(_hits(positions, intervals, pos), ["contig", pos], "left_anti")


def gene_strand(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    """negative strand of the features over a position; null if they disagree or none has one."""
    places = positions.select("contig", pos).distinct()
    strand = overlapping(places, intervals.select("contig", "start", "end", "negative"), pos).groupBy("contig", pos).agg(
        F.when(F.min("negative") == F.max("negative"), F.max("negative")).alias("negative")
    )
    return positions.join(strand, ["contig", pos], "left")


def single_feature(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    """The one feature over each position; an error where there are several."""
    found = overlapping(positions, intervals, pos).groupBy("contig", pos).agg(F.count("*").alias("n"), F.first("name").alias("name"))
    several = F.raise_error(F.concat(F.lit("several features at "), F.col("contig"), F.lit(":"), F.col(pos).cast("string")))
    return found.select("contig", pos, F.when(F.col("n") > 1, several.cast("string")).otherwise(F.col("name")).alias("name"))


def score_sums(positions: DataFrame, intervals: DataFrame, pos: str = "pos") -> DataFrame:
    """Sum of the scores of the features over each position, -1 without any."""
    sums = overlapping(positions.select("contig", pos).distinct(), intervals.select("contig", "start", "end", "score"), pos).groupBy("contig", pos).agg(F.sum("score").alias("score"))
    return positions.join(sums, ["contig", pos], "left").withColumn("score", F.coalesce("score", F.lit(-1)))


def feature_breakdown(coverage: DataFrame, intervals: DataFrame, value: str = "value") -> DataFrame:
    """Raw, length-normalised and TPM coverage of every feature; features without any have zero."""
    keys = intervals.select("name", "contig", "start", "end")
    sums = overlapping(coverage, keys).groupBy("name").agg(F.sum(value).alias("raw"))
    rows = keys.join(sums, "name", "left").select("name", (F.col("end") - F.col("start") + 1).alias("length"), F.coalesce("raw", F.lit(0)).alias("raw"))
    rows = rows.withColumn("normalised", F.col("raw") / F.col("length"))
    total = rows.agg(F.sum("normalised").alias("total"))
    return rows.join(F.broadcast(total)).select(
        "name", "length", "raw", F.round("normalised", 6).alias("normalised"), F.round(F.try_divide(F.col("normalised") * 1e6, F.col("total")), 4).alias("tpm")
    )


def normalised_coverage(coverage: DataFrame, intervals: DataFrame, value: str = "value") -> DataFrame:
    """Coverage of each place of a transcript over its mean, 80th and 95th percentile element.

    Percentiles come from counts of distinct values; no task holds the values of a transcript.
    """
    rows = overlapping(coverage, intervals.select("name", "contig", "start", "end"))
    element = lambda share: F.expr(f"percentile_disc({share + 1e-10:.12f}) WITHIN GROUP (ORDER BY `{value}`)")
    stats = rows.groupBy("name").agg(F.avg(value).alias("mean"), element(0.8).alias("p80"), element(0.95).alias("p95"))
    return rows.join(stats, "name").select(
        "name", "contig", "pos", *[F.round(F.try_divide(F.col(value), F.col(c)), 6).alias(f"over_{c}") for c in ("mean", "p80", "p95")]
    )


def touched(intervals: DataFrame, hits: DataFrame) -> DataFrame:
    """Intervals that hold any hit, and how many places they hold."""
    counts = overlapping(hits, intervals.select("name", "contig", "start", "end")).groupBy("name").agg(F.countDistinct("pos").alias("n_hits"))
    return intervals.join(counts, "name").select("name", "contig", "start", "end", "n_hits")


def running(rows: DataFrame, at: str, totals: list[str], stretch: int = STRETCH) -> DataFrame:
    """Running sums (as run_<name>) along each contig, and the next row's place (as next_at).

    A contig is dealt out in stretches of places: sums run inside a stretch, and each stretch gets
    what lies before it from the stretches' own totals, so no task holds a whole contig. Rows of one
    place must be one row.
    """
    cut = rows.withColumn("__part", F.floor(F.col(at) / stretch))
    parts = cut.groupBy("contig", "__part").agg(F.min(at).alias("__first"), *[F.sum(t).alias(f"__{t}") for t in totals])
    along = Window.partitionBy("contig").orderBy("__part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("contig", "__part", F.lead("__first").over(along).alias("__next"), *[F.coalesce(F.sum(f"__{t}").over(before), F.lit(0)).alias(f"__{t}") for t in totals])
    own = Window.partitionBy("contig", "__part").orderBy(at)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", F.lead(at).over(own).alias("__lead"), *[F.sum(t).over(upto).alias(f"__own_{t}") for t in totals])
    joined = local.join(parts, ["contig", "__part"])
    return joined.select(*rows.columns, F.coalesce("__lead", "__next").alias("next_at"), *[(F.col(f"__own_{t}") + F.col(f"__{t}")).alias(f"run_{t}") for t in totals])


def merge(intervals: DataFrame, slack: int = 1) -> DataFrame:
    """Union of intervals: islands of those that overlap or touch (within `slack`).

    Islands are made within stretches of starts first; only what is left of them is merged along
    whole contigs.
    """
    near = _islands(intervals.withColumn("__part", F.floor(F.col("start") / STRETCH)), ["contig", "__part"], slack)
    return _islands(near.select("contig", "start", "end"), ["contig"], slack).select("contig", "start", "end")


def _islands(intervals: DataFrame, keys: list[str], slack: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__reach", reach)
    new = F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + slack), 1).otherwise(0)
    numbered = marked.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _boundaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stretches between boundaries of two merged sets, with how many sets cover each."""

    def edges(df: DataFrame, side: str) -> DataFrame:
        plus = df.select("contig", F.col("start").alias("at"), F.lit(1).alias("d"), F.lit(side).alias("side"))
        return plus.union(df.select("contig", F.col("end") + 1, F.lit(-1), F.lit(side)))

    both = edges(merge(a), "a").union(edges(merge(b), "b"))
    steps = both.groupBy("contig", "at").agg(
        F.sum(F.when(F.col("side") == "a", F.col("d")).otherwise(0)).alias("da"), F.sum(F.when(F.col("side") == "b", F.col("d")).otherwise(0)).alias("db")
    )
    made = running(steps, "at", ["da", "db"])
    return made.select("contig", F.col("at").alias("start"), (F.col("next_at") - 1).alias("end"), F.col("run_da").alias("in_a"), F.col("run_db").alias("in_b")).where("end >= start")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(_boundaries(a, b).where("in_a > 0 AND in_b > 0").select("contig", "start", "end"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(_boundaries(a, b).where("in_a > 0 AND in_b = 0").select("contig", "start", "end"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(_boundaries(a, b).where("(in_a > 0) <> (in_b > 0)").select("contig", "start", "end"))


def invert(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """What intervals leave of contigs (contig, length)."""
    return subtract(contigs.select("contig", F.lit(0).cast("long").alias("start"), (F.col("length") - 1).alias("end")), intervals)


def pad(intervals: DataFrame, before: int, after: int) -> DataFrame:
    return intervals.withColumns({"start": F.greatest(F.col("start") - before, F.lit(0)), "end": F.col("end") + after})


def scatter(intervals: DataFrame, size: int) -> DataFrame:
    """Intervals cut at every multiple of `size`."""
    parts = F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))
    rows = intervals.withColumn("part", F.explode(parts))
    return rows.withColumns({"start": F.greatest("start", F.col("part") * size), "end": F.least("end", F.col("part") * size + size - 1)}).drop("part")


def threshold_runs(values: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Runs of neighbouring positions at or above a threshold, with the last position's value."""
    kept = values.where(F.col(value) >= threshold).withColumn("__part", F.floor(F.col("pos") / STRETCH))
    order = Window.partitionBy("contig", "__part").orderBy("pos")
    rows = kept.withColumn("__run", F.col("pos") - F.row_number().over(order))
    runs = rows.groupBy("contig", "__part", "__run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max_by(value, "pos").alias("last_value"))
    # runs of neighbouring stretches that touch are one
    along = Window.partitionBy("contig").orderBy("start")
    new = F.when(F.col("start") == F.lag("end").over(along) + 1, 0).otherwise(1)
    numbered = runs.withColumn("__new", new).withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("contig", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("last_value", "end").alias("last_value"))
    return whole.drop("__island")


def moving_average(values: DataFrame, alpha: float, bin_size: int, threshold: float | None = None, value: str = "value") -> DataFrame:
    """Exponential moving average along each contig, given out every bin_size + 1 positions.

    Values below `threshold` leave the average as it is. The recursion is linear, so a part of a contig
    gives a factor and an average of its own; parts are short enough for the factors to stay in range.
    Only the parts' pairs, one for many positions, are gone through in order along a contig.
    """
    import math

    import pandas as pd

    keep = 1.0 - alpha
    most = max(1, int(200 / -math.log(keep)))
    on = F.lit(1) if threshold is None else F.when(F.col(value) >= threshold, 1).otherwise(0)
    rows = values.select("contig", F.col("pos").cast("long").alias("pos"), F.col(value).cast("double").alias("value"), on.alias("on"), F.lit(1).alias("one"))
    counted = running(rows, "pos", ["one", "on"])
    counted = counted.withColumns({"p": F.floor((F.col("run_one") - 1) / STRETCH), "q": F.floor(F.col("run_on") / most)})
    part = Window.partitionBy("contig", "p", "q")
    steps = F.col("run_on") - F.min(F.col("run_on") - F.col("on")).over(part)
    local = counted.withColumn("e", steps)
    weight = F.when(F.col("on") == 1, alpha * F.col("value") * F.pow(F.lit(keep), -F.col("e"))).otherwise(0.0)
    local = local.withColumn("own", F.pow(F.lit(keep), F.col("e")) * F.sum(weight).over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("contig", "p", "q").agg(F.max("e").alias("e"), F.max_by("own", "pos").alias("own"))

    def carried(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["p", "q"])
        before, found = 0.0, []
        for e, own in zip(group["e"], group["own"], strict=True):
            found.append(before)
            before = keep**e * before + own
        return pd.DataFrame({"contig": group["contig"], "p": group["p"], "q": group["q"], "before": found})

    carry = ends.groupBy("contig").applyInPandas(carried, "contig string, p long, q long, before double")
    made = local.where(F.col("run_one") % (bin_size + 1) == 0).join(carry, ["contig", "p", "q"])
    return made.select("contig", "pos", (F.col("own") + F.pow(F.lit(keep), F.col("e")) * F.col("before")).alias("ema"))


def dense_histogram(values: DataFrame, top: int, value: str = "value") -> DataFrame:
    """Rows of every value from 0 to `top`, with zero where none has it."""
    counts = values.groupBy(F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return values.sparkSession.range(top + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])


def sum_arrays(parts: list[DataFrame], value: str = "value") -> DataFrame:
    """Sum of position arrays; all must hold the same positions."""
    first, *others = parts
    every = first.select("contig", "pos", value)
    for other in others:
        every = every.unionByName(other.select("contig", "pos", value))
    summed = every.groupBy("contig", "pos").agg(F.sum(value).alias(value), F.count("*").alias("n"))
    wrong = F.raise_error(F.lit("arrays differ in contigs or lengths"))
    return summed.select("contig", "pos", F.when(F.col("n") == len(parts), F.col(value)).otherwise(wrong.cast("long")).alias(value))


def lift_over(intervals: DataFrame, chain_blocks: DataFrame, least_match: float = 0.95) -> DataFrame:
    """Intervals moved along chain blocks (chain, contig, start, end, to_contig, to_start).

    An interval is moved if exactly one chain covers `least_match` of its length, else it is null.
    """
    pieces = F.sequence(F.floor(F.col("i_start") / BIN), F.floor(F.col("i_end") / BIN))
    left = intervals.select("name", "contig", F.col("start").alias("i_start"), F.col("end").alias("i_end")).withColumn("bin", F.explode(pieces))
    right = chain_blocks.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))
    met = left.join(right, ["contig", "bin"]).where("i_start <= end AND start <= i_end").drop("bin").distinct()
    low, high = F.greatest("i_start", "start"), F.least("i_end", "end")
    per_chain = met.groupBy("name", "i_start", "i_end", "chain", "to_contig").agg(
        F.sum(high - low + 1).alias("covered"),
        F.min(F.col("to_start") + low - F.col("start")).alias("new_start"),
        F.max(F.col("to_start") + high - F.col("start")).alias("new_end"),
    ).where(F.col("covered") >= least_match * (F.col("i_end") - F.col("i_start") + 1))
    single = per_chain.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("to_contig", "new_start", "new_end")).alias("t")).where("n = 1")
    return intervals.select("name").join(single, "name", "left").select("name", "t.to_contig", "t.new_start", "t.new_end")
