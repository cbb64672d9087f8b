"""Rearrangements from split alignments and pairs that lie apart.

A split read has two halves, each with the other one in its `SA` tag. The half whose end is clipped on the
right leads to the junction, the one clipped on the left goes on behind it; two halves clipped on one side are an inversion.
Junctions within a few places of each other are one call, over all samples; pairs whose inner ends lie on
both sides of it support it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..params import Params
from . import molecules
from .reads import FIRST, MATE_UNMAPPED, PAIRED, SECONDARY, SUPPLEMENTARY, UNMAPPED, flagged

SIDES = ["contig", "place", "other_contig", "other_place"]
SLACK = 10


def _break(half: Column) -> list[Column]:
    """Whether a half leads to the junction, and its place next to it."""
    return [half["right_break"].isNotNull(), F.coalesce(half["right_break"], half["left_break"])]


def junctions(reads: DataFrame) -> DataFrame:
    """(sample, qname, is_first, kind, contig, place, other_contig, other_place), one row for each split read and junction.

    Both halves of a read tell the same junction and count once. Reads without a tag of exactly one other half, or
    without a clipped end, have none. The kind follows from the sides and `inverted`, and is made behind the shuffle.
    """
    mapped = reads.where(~flagged(UNMAPPED) & ~flagged(SECONDARY))
    rows = mapped.withColumn("__other", C.supplementary(F.try_element_at("tags", F.lit("SA")))).where("__other IS NOT NULL AND cigar RLIKE '[SH]' AND __other.cigar RLIKE '[SH]'")
    soft = lambda c: F.translate(c, "H", "S")  # noqa: E731  of hard-clipped halves the clip is as long
    right1, p1 = _break(C.split_read(soft(F.col("cigar")), F.col("start")))
    right2, p2 = _break(C.split_read(soft(F.col("__other.cigar")), F.col("__other.start")))
    rows = rows.select("sample", "qname", flagged(FIRST).alias("is_first"), F.col("contig").alias("c1"), p1.alias("p1"), right1.alias("right1"), F.col("__other.contig").alias("c2"), p2.alias("p2"), right2.alias("right2"), (flagged(16) != F.col("__other.negative")).alias("turned"))
    one_side = F.col("right1") == F.col("right2")
    ahead = F.when(one_side, F.struct("c1", "p1") <= F.struct("c2", "p2")).otherwise(F.col("right1"))
    # of sides on one contig; with the sides it tells the kind
    inverted = ~F.coalesce(F.col("c1") != F.col("c2"), F.lit(False)) & F.coalesce(F.col("turned") | one_side, F.lit(False))
    rows = rows.select("sample", "qname", "is_first", "c1", "p1", "c2", "p2", ahead.alias("ahead"), inverted.alias("inverted"))
    side = lambda c, d: F.when(F.col("ahead"), F.col(c)).otherwise(F.col(d))
    made = rows.select("sample", "qname", "is_first", "inverted", side("c1", "c2").alias("contig"), side("p1", "p2").alias("place"), side("c2", "c1").alias("other_contig"), side("p2", "p1").alias("other_place"))
    # distinct rows; numbers stand before texts, so that a shuffle's rows are alike for long and compress
    once = made.groupBy("is_first", "inverted", "place", "other_place", "sample", "contig", "other_contig", "qname").agg(F.count("*").alias("halves"))
    kind = C.rearrangement(F.col("contig"), F.col("place"), F.lit(False), F.col("other_contig"), F.col("other_place"), F.col("inverted"))
    return once.select("sample", "qname", "is_first", kind.alias("kind"), *SIDES)


def far_pairs(reads: DataFrame, params: Params = Params()) -> DataFrame:
    """(sample, qname, contig, place, other_contig, other_place): inner ends of pairs on two contigs, not facing each other, or too far apart."""
    whole = flagged(PAIRED) & ~flagged(UNMAPPED) & ~flagged(MATE_UNMAPPED) & ~flagged(SECONDARY) & ~flagged(SUPPLEMENTARY)
    inner = F.when(flagged(16), F.col("start")).otherwise(C.reference_end(F.col("cigar"), F.col("start")))
    end = F.struct("contig", inner.alias("place"), flagged(16).alias("negative"))
    ends = reads.where(whole).groupBy("sample", "qname").agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count("*").alias("n")).where("n = 2")
    facing = ~F.col("a.negative") & F.col("b.negative")
    near = (F.col("a.contig") == F.col("b.contig")) & facing & (F.col("b.place") - F.col("a.place") <= params.maxInsertSize)
    return ends.where(~near).select("sample", "qname", F.col("a.contig").alias("contig"), F.col("a.place").alias("place"), F.col("b.contig").alias("other_contig"), F.col("b.place").alias("other_place"))


def clustered(found: DataFrame, slack: int = SLACK) -> DataFrame:
    """Junctions with `call`: those of one kind whose places on both sides follow each other within `slack`, over all samples."""
    named = found.withColumn("__kind", F.concat_ws("\t", "kind", "contig", "other_contig"))

    def islands(rows: DataFrame, key: Column, place: str) -> DataFrame:
        own = rows.withColumn("__key", key)
        keyed = own.select(F.lit("").alias("sample"), F.col("__key").alias("contig"), F.col(place).alias("left_start")).distinct()
        marks = molecules.start_islands(keyed, slack).select(F.col("contig").alias("__key"), F.col("left_start").alias(place), F.col("island").alias("__island"))
        return own.join(marks, ["__key", place])

    by_first = islands(named, F.col("__kind"), "place").withColumn("__kind", F.concat_ws("\t", "__kind", "__island")).drop("__island", "__key")
    by_both = islands(by_first, F.col("__kind"), "other_place")
    return by_both.withColumn("call", F.concat_ws("\t", "__kind", "__island")).drop("__kind", "__island", "__key")


def called(reads: DataFrame, params: Params = Params(), slack: int = SLACK, least: int = 1) -> DataFrame:
    """(sample, kind, contig, place, other_contig, other_place, n_split, n_pairs, unique) of calls with `least` split reads in a sample.

    Places are the first ones of the call. `unique`: no other sample has a split read there.
    """
    rows = clustered(junctions(reads), slack)
    calls = rows.groupBy("call").agg(F.first("kind").alias("kind"), F.first("contig").alias("contig"), F.min("place").alias("place"), F.first("other_contig").alias("other_contig"), F.min("other_place").alias("other_place"), F.countDistinct("sample").alias("n_samples"))
    support = rows.groupBy("call", "sample").agg(F.countDistinct("qname").alias("n_split"))
    reach = params.maxInsertSize
    bins = F.explode(F.array(*[F.expr(f"place div {reach}") + k for k in (-1, 0, 1)])).alias("bin")
    pairs = far_pairs(reads, params)
    turned = pairs.select("sample", "qname", F.col("other_contig").alias("contig"), F.col("other_place").alias("place"), F.col("contig").alias("other_contig"), F.col("place").alias("other_place"))
    ends = pairs.union(turned).select("sample", "qname", "contig", "other_contig", F.col("place").alias("p"), F.col("other_place").alias("q"), F.expr(f"place div {reach}").alias("bin"))
    near = (F.abs(F.col("p") - F.col("place")) <= reach) & (F.abs(F.col("q") - F.col("other_place")) <= reach)
    beside = calls.select("call", "contig", "other_contig", "place", "other_place", bins).join(ends, ["contig", "other_contig", "bin"]).where(near)
    spanning = beside.groupBy("call", "sample").agg(F.countDistinct("qname").alias("n_pairs"))
    made = support.where(F.col("n_split") >= least).join(calls, "call").join(spanning, ["call", "sample"], "left")
    return made.select("sample", "kind", *SIDES, "n_split", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.col("n_samples") == 1).alias("unique"))


def members(reads: DataFrame, slack: int = SLACK) -> DataFrame:
    """All alignments of the reads and mates, however far, whose names have a junction, with its `call`."""
    names = clustered(junctions(reads), slack).select("sample", "qname", "call").distinct()
    return reads.join(names, ["sample", "qname"])
