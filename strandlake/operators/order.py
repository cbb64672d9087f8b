"""Numbering rows of a total order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_in_packs

#: Rows of one partition that an id of Spark's can tell apart, in bits.
ROW_BITS = 33
SALT_SEED = 11


def numbered(rows: DataFrame, order: list, name: str = "place", keep: list[str] | None = None) -> DataFrame:
    """`rows` in range partitions of `order`, with their place (long, from 1) in all of it.

    Rows are sorted within ranges and kept so by a cut; a row's place is its number within the range
    plus the rows of the ranges before it. What is gathered has one row a partition. With `keep`, only these
    columns stay beside the place, and the cut holds them in packs.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = (cut(ordered) if keep is None else cut_in_packs(ordered.select(*keep))).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumn("__part", F.shiftright("__id", ROW_BITS))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return held.join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__id", "__part", "__before")


def ranged(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` in range partitions of (group, order), sorted within them and kept so by a cut.

    `__part` is a row's range and `__at` its place in the range, from 0. A group, however large, is
    spread over as many ranges as its rows need; rows that are equal in all of `order` are told
    apart by a drawn `__salt`, so they may lie in several ranges too. `group` must not be null.
    """
    keys = [group, *order, "__salt"]
    held = cut(rows.withColumn("__salt", F.rand(SALT_SEED)).repartitionByRange(*keys).sortWithinPartitions(*keys))
    held = held.withColumn("__at", F.monotonically_increasing_id())
    return held.withColumn("__part", F.shiftright("__at", ROW_BITS)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))


def stretches(held: DataFrame, group: str, value: Column) -> DataFrame:
    """For each range and group of `ranged` rows: the sum of `value` in the group's earlier ranges, and in all of them.

    One row for each (`__part`, group), with `__first` (place of its first row in the range), `__before` and `__all`.
    Both exchanges combine first; a group has at most one row a range.
    """
    parts = held.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.sum(value).cast("long").alias("__sum"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__sum").over(earlier), F.lit(0).cast("long"))
    return parts.select("__part", group, "__first", before.alias("__before"), F.sum("__sum").over(whole).alias("__all"))


def numbered_within(rows: DataFrame, group: str, order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """`rows` with their place (long, from 0) in their group, in `order`, and the group's number of rows."""
    held = ranged(rows, group, order)
    found = held.join(stretches(held, group, F.lit(1)), ["__part", group])
    named = found.withColumns({place: F.col("__before") + F.col("__at") - F.col("__first"), size: F.col("__all")})
    return named.select(*rows.columns, place, size)


def summed_before(held: DataFrame, group: str, order: list[str], value: Column) -> Column:
    """Sum of `value` over the earlier rows of a row's own range and group."""
    own = Window.partitionBy("__part", group).orderBy(*order, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(own), F.lit(0).cast("long"))
