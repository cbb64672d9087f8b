"""Mixing sources to target weights by hash-random order and exact budgets.

Every row gets a random key, a hash of a seed, its id and its text. Rows are range-sorted by key
within each source, and the sizes before each row are summed over ranges and then within them. A
source's budget is cut exactly there: whole epochs of all its rows, and of one epoch more the rows
up to the budget, the last of them in part. Only DataFrame functions are used.

Targets share the size of all rows by weight; a source whose share is over `EPOCHS` times its size
stops there, and the excess is shared by weight among the others, until none is above. That is one
level of size for each unit of weight, found from sums over the sources by the ratio of limit and weight.

Defined results: a null or wordless text has size 0 and none of it is taken; a null source is one
source, the last; equal rows are rows of their own, and rows that differ in nothing are taken in any
order; rows without an id are told apart by their texts; an empty table gives an empty result;
other columns are carried only if asked for. Reruns agree, for any partitioning of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered, ranged, stretches, summed_before

WORD = r"[^\x20\x09-\x0D]+"
#: Times that a document may be taken, at most.
EPOCHS = 3
#: Weights of the sources in their order, repeated.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-"))))


def group_of(source: Column) -> Column:
    """A name that is never null and puts sources in order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def cycled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources (`__group`, `__all`) with `__weight`: the weights in the sources' order, repeated."""
    turn = F.array(*map(F.lit, weights))
    return numbered(sources, ["__group"]).withColumn("__weight", F.get(turn, (F.col("place") - 1) % len(weights)).cast("long")).drop("place")


def targets(weighted: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(`__group`, target) of sources (`__group`, size `__all`, `__weight` of 1 or more); see the module's text."""
    rows = weighted.select(F.lit("").alias("__one"), "__group", "__all", "__weight", (F.lit(epochs) * F.col("__all")).alias("__most"))
    rows = rows.withColumn("__ratio", F.col("__most").cast("double") / F.col("__weight"))
    order = ["__ratio", "__group"]
    held = ranged(rows, "__one", order)
    before = {}
    for name in ("__most", "__weight"):
        before[name] = summed_before(held, "__one", order, F.col(name)) + F.col(f"{name}_earlier")
        held = held.join(stretches(held, "__one", F.col(name)).select("__part", F.col("__before").alias(f"{name}_earlier")), "__part")
    held = held.withColumns({f"{name}_before": value for name, value in before.items()})
    total, shares = held.agg(F.sum("__all"), F.sum("__weight")).first()
    level = (F.lit(total) - F.col("__most_before")).cast("double") / (F.lit(shares) - F.col("__weight_before")).cast("double")
    open_ = held.withColumn("__level", level).where("__ratio > __level")
    found = open_.agg(F.min_by("__level", F.struct(*order))).first()[0]
    most = F.col("__most").cast("double")
    # without an open source all stop at their limits
    share = most if found is None else F.when(F.col("__ratio") <= F.lit(found), most).otherwise(F.lit(found) * F.col("__weight"))
    return rows.select("__group", share.alias("target"))


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and key for every row, with the `keep` columns.

    `weights`: those of sources in order, repeated, or a table (source, weight) that has every
    source once. A row is taken whole `taken div size` times, and its first `taken % size` words once more.
    """
    more = [c for c in keep or [] if c not in ("doc_id", "source")]
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", *more, group_of(F.col("source")).alias("__group"), size.alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    order = ["key", "doc_id", "size"]
    held = ranged(rows, "__group", order)
    parts = stretches(held, "__group", F.col("size"))
    sources = parts.groupBy("__group").agg(F.first("__all").alias("__all"))
    if isinstance(weights, DataFrame):
        given = weights.select(group_of(F.col("source")).alias("__group"), F.col("weight").cast("long").alias("__weight"))
        weighted = sources.join(given, "__group")
    else:
        weighted = cycled(sources, weights)
    parts = parts.join(targets(weighted, epochs), "__group").drop("__first")
    found = held.withColumn("__own", summed_before(held, "__group", order, F.col("size"))).join(parts, ["__part", "__group"])
    budget, whole = F.floor("target").cast("long"), F.col("__all")
    turns = F.when(whole > 0, F.expr("CAST(floor(target) AS BIGINT) div __all")).otherwise(F.lit(0).cast("long"))
    rest = budget - turns * whole - F.col("__before") - F.col("__own")
    part = F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))
    return found.select("doc_id", "source", *more, "size", whole.alias("source_size"), "target", (turns * F.col("size") + part).alias("taken"), "key")


def epochs_of(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each time that a row of `mix` (with its text kept) is taken: `epoch` from 0, `words` taken and the text.

    The row at a source's budget has its first words only, joined by spaces.
    """
    times = F.when(F.col("taken") > 0, F.sequence(F.lit(0).cast("long"), F.expr("(taken + size - 1) div size") - 1)).otherwise(F.array().cast("array<long>"))
    rows = mixed.withColumn("epoch", F.explode(times)).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    return rows.withColumn(text, F.when(F.col("words") < F.col("size"), first).otherwise(F.col(text)))
