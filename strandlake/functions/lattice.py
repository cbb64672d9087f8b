"""The quality lattice: four ordered levels, combined over assays kept as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATROCIOUS, POOR, DUBIOUS, GOOD = -1, 0, 1, 2


def graded(q2: Column, q1: Column | None = None, otherwise: int = POOR) -> Column:
    """GOOD where q2 holds, DUBIOUS where q1 does, else `otherwise`."""
    level = F.when(q2, GOOD)
    if q1 is not None:
        level = level.when(q1, DUBIOUS)
    return level.otherwise(otherwise)


def combine(least: list[Column], greatest: list[Column] = ()) -> Column:
    """Smaller of the minimum of `least` and the maximum of `greatest`; nulls are absent assays."""
    parts = [F.least(*least, F.lit(None).cast("int")) if len(least) == 1 else F.least(*least)] if least else []
    if greatest:
        parts.append(F.greatest(*greatest, F.lit(None).cast("int")) if len(greatest) == 1 else F.greatest(*greatest))
    return parts[0] if len(parts) == 1 else F.least(*parts)


def ignoring(assays: dict[str, Column], names: set[str]) -> Column:
    """Value over the assays that are not in `names`; GOOD if none is left."""
    return F.least(F.lit(GOOD), *[c for n, c in assays.items() if n not in names], F.lit(GOOD))


def named(level: Column) -> Column:
    return F.when(level == GOOD, "GOOD").when(level == DUBIOUS, "DUBIOUS").when(level == POOR, "POOR").when(level == ATROCIOUS, "ATROCIOUS")
