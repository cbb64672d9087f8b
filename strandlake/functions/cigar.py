"""CIGAR strings as arrays, and what follows from them, with higher-order functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<ref:int,read:int,len:int,op:string>"


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """`function` of a value that is made once for a row, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def elements(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def _advance(op: Column, kinds: tuple[str, ...], length: Column) -> Column:
    return F.when(op.isin(*kinds), length).otherwise(F.lit(0))


def blocks(cigar: Column, start: Column) -> Column:
    """array<struct<ref, read, len, op>>: every element with the places where it begins.

    M, = and X advance both sequences; S and I the read; N and D the reference; H and P neither.
    """
    zero = F.struct(start.cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast(f"array<{BLOCK}>").alias("found"))

    def step(acc: Column, e: Column) -> Column:
        here = F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), e["len"].alias("len"), e["op"].alias("op"))
        return F.struct(
            (acc["ref"] + _advance(e["op"], ("M", "=", "X", "D", "N"), e["len"])).alias("ref"),
            (acc["read"] + _advance(e["op"], ("M", "=", "X", "I", "S"), e["len"])).alias("read"),
            F.concat(acc["found"], F.array(here)).alias("found"),
        )

    return F.aggregate(elements(cigar), zero, step, lambda acc: acc["found"])


def aligned_blocks(cigar: Column, start: Column) -> Column:
    return F.filter(blocks(cigar, start), lambda b: b["op"].isin("M", "=", "X"))


def total(cigar: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(elements(cigar), F.lit(0), lambda a, e: a + _advance(e["op"], kinds, e["len"]))


def reference_end(cigar: Column, start: Column) -> Column:
    """Last reference place that the alignment covers."""
    return start + total(cigar, ("M", "=", "X", "D", "N")) - 1


def leading_clip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))


def trailing_clip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))


def unclipped_start(cigar: Column, start: Column) -> Column:
    return start - leading_clip(cigar)


def unclipped_end(cigar: Column, start: Column) -> Column:
    return reference_end(cigar, start) + trailing_clip(cigar)


def clipped_bases(cigar: Column, start: Column, negative: Column, mate_unclipped: Column) -> Column:
    """Soft-clipped bases, less those that run past the mate's unclipped far end (adapter)."""
    through_right = F.greatest(F.lit(0), unclipped_end(cigar, start) - mate_unclipped)
    through_left = F.greatest(F.lit(0), mate_unclipped - unclipped_start(cigar, start))
    left = F.when(negative, F.greatest(F.lit(0), leading_clip(cigar) - F.coalesce(through_left, F.lit(0)))).otherwise(leading_clip(cigar))
    right = F.when(negative, trailing_clip(cigar)).otherwise(F.greatest(F.lit(0), trailing_clip(cigar) - F.coalesce(through_right, F.lit(0))))
    return left + right


def read_position(cigar: Column, start: Column, place: Column) -> Column:
    """Read place (from 0) of a reference place; outside the alignment it is extrapolated.

    Inside a deletion it is the read place where the deletion begins. Null without aligned bases.
    """

    def ends(found: Column) -> Column:
        inside = F.filter(found, lambda b: b["op"].isin("M", "=", "X", "D", "N") & (place >= b["ref"]) & (place < b["ref"] + b["len"]))
        aligned = F.filter(found, lambda b: b["op"].isin("M", "=", "X"))
        return bound(aligned, lambda a: F.struct(F.try_element_at(inside, F.lit(1)).alias("hit"), F.try_element_at(a, F.lit(1)).alias("first"), F.try_element_at(a, F.lit(-1)).alias("last")))

    def position(e: Column) -> Column:
        hit, first, last = e["hit"], e["first"], e["last"]
        return (
            F.when(hit.isNotNull(), F.when(hit["op"].isin("D", "N"), hit["read"]).otherwise(hit["read"] + place - hit["ref"]))
            .when(place < first["ref"], first["read"] - (first["ref"] - place))
            .otherwise(last["read"] + place - last["ref"])
        )

    return bound(bound(blocks(cigar, start), ends), position)


def ligation_distance(own_end: Column, mate_end: Column, allowed: int) -> Column:
    """How far inside the `allowed` bases of a ligation site a base lies: 0 or more is too close."""
    return F.greatest(allowed - own_end, allowed - F.coalesce(mate_end, own_end))


def pair_orientation(negative: Column, mate_negative: Column, five_prime: Column, mate_five_prime: Column) -> Column:
    """FR, RF or TANDEM from the unclipped 5' ends."""
    forward = F.when(negative, mate_five_prime).otherwise(five_prime)
    backward = F.when(negative, five_prime).otherwise(mate_five_prime)
    return F.when(negative == mate_negative, "TANDEM").when(forward <= backward, "FR").otherwise("RF")


def wrong_pair(unmapped: Column, mate_unmapped: Column, contig: Column, mate_contig: Column, orientation: Column) -> Column:
    return unmapped | mate_unmapped | (contig != mate_contig) | orientation.isin("TANDEM", "RF")


def split_read(cigar: Column, start: Column) -> Column:
    """struct<matched, left_clip, right_clip, left_break, right_break> of a split alignment."""
    matched = F.filter(elements(cigar), lambda e: e["op"].isin("M", "=", "X"))
    left, right = leading_clip(cigar), trailing_clip(cigar)
    return F.struct(
        F.array_max(F.transform(matched, lambda e: e["len"])).alias("matched"),
        left.alias("left_clip"),
        right.alias("right_clip"),
        F.when(left >= right, start).otherwise(F.lit(None).cast("int")).alias("left_break"),
        F.when(right > left, reference_end(cigar, start)).otherwise(F.lit(None).cast("int")).alias("right_break"),
    )


def supplementary(tag: Column) -> Column:
    """struct<contig, start, negative, cigar, mapq> of an `SA` tag with exactly one alignment, else null."""
    entries = F.filter(F.split(tag, ";"), lambda e: e != "")
    fields = F.split(F.element_at(entries, 1), ",")
    made = F.struct(
        fields[0].alias("contig"), (fields[1].cast("int") - 1).alias("start"), (fields[2] == "-").alias("negative"), fields[3].alias("cigar"), fields[4].cast("int").alias("mapq")
    )
    return F.when(F.size(entries) == 1, made)


def rearrangement(contig: Column, place: Column, negative: Column, other_contig: Column, other_place: Column, other_negative: Column) -> Column:
    """Kind of a junction between two places of a split read."""
    return (
        F.when(contig != other_contig, "INTERCHROMOSOMAL")
        .when(negative != other_negative, "INVERSION")
        .when(other_place < place, "TANDEM_REPEAT")
        .otherwise("DELETION")
    )


def trim_soft_clips(cigar: Column, seq: Column) -> Column:
    """struct<cigar, seq> without soft-clipped bases."""
    left, right = leading_clip(cigar), trailing_clip(cigar)
    return F.struct(
        F.regexp_replace(F.regexp_replace(cigar, r"^((?:\d+H)?)\d+S", "$1"), r"\d+S((?:\d+H)?)$", "$1").alias("cigar"),
        F.substr(seq, left + 1, F.length(seq) - left - right).alias("seq"),
    )


def overlap_clip(own_end: Column, mate_start: Column) -> Column:
    """Bases of a read that overlap its mate and are to be hard-clipped."""
    return F.greatest(F.lit(0), own_end - mate_start + 1)


def intron_adjusted_end(cigar: Column, start: Column, within: int = 16) -> Column:
    """Alignment end before an intron that begins within the last `within` read bases."""
    found = blocks(cigar, start)
    size = total(cigar, ("M", "=", "X", "I", "S"))
    introns = F.filter(found, lambda b: (b["op"] == "N") & (size - b["read"] <= within))
    return F.coalesce(F.array_min(F.transform(introns, lambda b: b["ref"] - 1)), reference_end(cigar, start))
