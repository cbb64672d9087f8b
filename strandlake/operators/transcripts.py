"""Reads against gene models: what kind of place each base is at, coverage along spliced transcripts, bias of their ends.

A transcript is a row (name, gene, contig, start, end, negative, coding_start, coding_end, exon_starts, exon_ends)
with 0-based places; `end` is the last one, coding and exon ends are the first place behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping, running

#: Kinds of places, the first that holds being a place's own.
KINDS = ("RIBOSOMAL", "CODING", "UTR", "INTRONIC", "INTERGENIC")


def exons(transcripts: DataFrame) -> DataFrame:
    """(name, contig, negative, start, end, before, length): exons with closed ends, the spliced bases before each, and those of all."""
    both = F.arrays_zip(F.col("exon_starts").alias("s"), F.col("exon_ends").alias("e"))
    rows = transcripts.select("name", "contig", "negative", F.posexplode(both).alias("k", "x")).select("name", "contig", "negative", "k", F.col("x.s").alias("start"), (F.col("x.e") - 1).alias("end"))
    own = Window.partitionBy("name", "contig")  # the exons of one transcript
    size = F.col("end") - F.col("start") + 1
    before = F.coalesce(F.sum(size).over(own.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"before": before, "length": F.sum(size).over(own)}).drop("k")


def parts(transcripts: DataFrame, ribosomal: DataFrame | None = None) -> DataFrame:
    """(contig, start, end, kind) of coding and untranslated exon parts, introns and ribosomal stretches; they may overlap."""
    both = F.arrays_zip(F.col("exon_starts").alias("s"), F.col("exon_ends").alias("e"))
    each = transcripts.select("contig", "coding_start", "coding_end", F.explode(both).alias("x"))
    low, high = F.greatest("x.s", "coding_start"), F.least("x.e", "coding_end")
    exon = each.select("contig", F.col("x.s").alias("start"), (F.col("x.e") - 1).alias("end"), F.lit("UTR").alias("kind"))
    coding = each.where(low < high).select("contig", low.alias("start"), (high - 1).alias("end"), F.lit("CODING").alias("kind"))
    # a gene's stretch counts where no exon does
    gene = transcripts.select("contig", "start", "end", F.lit("INTRONIC").alias("kind"))
    made = [exon, coding, gene] + ([] if ribosomal is None else [ribosomal.select("contig", "start", "end", F.lit("RIBOSOMAL").alias("kind"))])
    return reduce(DataFrame.unionByName, made)


def swept(coverage: DataFrame, kinds: DataFrame, names: tuple[str, ...], value: str = "value") -> DataFrame:
    """(kind, bases): covered bases by the first of `names` that holds at their place; the last one is for all others.

    Covered places and stretches (contig, start, end, kind) are steps up and down on one line; sums run along it
    in stretches of a contig, so neither bases meet intervals in a join nor does a task hold a contig.
    """
    tested = names[:-1]
    columns = ["value", *tested]

    def step(at: Column, n: Column, kind: Column | None) -> Column:
        own = [n.cast("long").alias("value") if kind is None else F.lit(0).cast("long").alias("value")]
        own += [F.lit(0).cast("long").alias(k) if kind is None else F.when(kind == k, n.cast("long")).otherwise(F.lit(0).cast("long")).alias(k) for k in tested]
        return F.struct(at.cast("long").alias("at"), *own)

    covered = coverage.select("contig", F.explode(F.array(step(F.col("pos"), F.col(value), None), step(F.col("pos") + 1, -F.col(value), None))).alias("s"))
    marked = kinds.select("contig", F.explode(F.array(step(F.col("start"), F.lit(1), F.col("kind")), step(F.col("end") + 1, F.lit(-1), F.col("kind")))).alias("s"))
    steps = covered.union(marked).select("contig", "s.*").groupBy("contig", "at").agg(*[F.sum(c).alias(c) for c in columns])
    runs = running(steps, "at", columns).where("run_value <> 0 AND next_at IS NOT NULL")
    kind = F.lit(names[-1])
    for name in reversed(tested):
        kind = F.when(F.col(f"run_{name}") > 0, F.lit(name)).otherwise(kind)
    return runs.groupBy(kind.alias("kind")).agg(F.sum(F.col("run_value") * (F.col("next_at") - F.col("at"))).alias("bases"))


def locus_bases(coverage: DataFrame, transcripts: DataFrame, ribosomal: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(kind, bases) of covered places (contig, pos, value); of overlapping transcripts the kind that comes first in `KINDS` counts."""
    return swept(coverage, parts(transcripts, ribosomal), KINDS, value)


def spliced_coverage(coverage: DataFrame, transcripts: DataFrame, value: str = "value") -> DataFrame:
    """(name, place, value): coverage at each place of a transcript, counted from its 5' end over its exons."""
    pieces = exons(transcripts)
    rows = overlapping(coverage, pieces.select("name", "contig", "start", "end", "before", "length", "negative"))
    forward = F.col("before") + F.col("pos") - F.col("start")
    place = F.when(F.col("negative"), F.col("length") - 1 - forward).otherwise(forward)
    return rows.select("name", place.alias("place"), F.col(value).alias("value"))


def end_bias(coverage: DataFrame, transcripts: DataFrame, end: int = 100, least_length: int = 0, value: str = "value") -> DataFrame:
    """(name, length, mean, cv, five_prime, three_prime) of each transcript that has any coverage.

    five_prime and three_prime: mean coverage of the first and last `end` places over the mean of all;
    cv: standard deviation over mean. Places without coverage count as 0.
    """
    rows = spliced_coverage(coverage, transcripts, value).groupBy("name", "place").agg(F.sum("value").alias("value"))
    lengths = exons(transcripts).groupBy("name").agg(F.max("length").alias("length"))
    each = rows.join(lengths, "name").where(F.col("length") >= least_length)
    reach = F.least(F.lit(end), F.col("length"))
    sums = each.groupBy("name", "length").agg(
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.sum(F.when(F.col("place") < reach, F.col("value")).otherwise(0)).alias("first"),
        F.sum(F.when(F.col("place") >= F.col("length") - reach, F.col("value")).otherwise(0)).alias("last"),
    )
    mean = F.col("total") / F.col("length")
    # over whole numbers up to one root and one division, so that nothing needs rounding
    spread = F.sqrt((F.col("length") * F.col("squares") - F.col("total") * F.col("total")).cast("double"))
    of = lambda c: (F.col(c) * F.col("length")) / (F.least(F.lit(end), F.col("length")) * F.col("total"))
    return sums.where("total > 0").select("name", "length", mean.alias("mean"), (spread / F.col("total")).alias("cv"), of("first").alias("five_prime"), of("last").alias("three_prime"))


def bias_summary(biases: DataFrame, most: int = 1000) -> DataFrame:
    """Medians over the `most` transcripts with the highest mean coverage, which is what such reports are about."""
    top = biases.orderBy(F.desc("mean"), "name").limit(most)
    return top.agg(F.count("*").alias("transcripts"), *[F.round(F.median(c), 6).alias(f"median_{c}") for c in ("cv", "five_prime", "three_prime")])
