"""Stand-alone programs over reads: duplicates, library size, metrics, conversions, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import drawn
from ..session import cut
from . import intervals, molecules, transcripts
from .reads import FIRST, SECONDARY, SUPPLEMENTARY, flagged


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """Pairs with one library, contig, both 5' ends and orientations: all but the best are duplicates.

    Best: largest sum of base qualities of 15 and more over both reads, then the smallest pair_id.
    """
    key = ["library", "contig", "five_prime", "mate_five_prime", "orientation"]
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "pair_id")
    return reads.withColumn("duplicate", F.row_number().over(order) > 1)


def duplicate_fragments(fragments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unpaired reads: duplicates of any pair's end at their place, else all but the best of their own."""
    ends = pairs.select("library", "contig", "five_prime").distinct().withColumn("paired_here", F.lit(True))
    order = Window.partitionBy("library", "contig", "five_prime").orderBy(F.desc("score"), "pair_id")
    joined = fragments.join(ends, ["library", "contig", "five_prime"], "left")
    return joined.withColumn("duplicate", F.coalesce("paired_here", F.lit(False)) | (F.row_number().over(order) > 1)).drop("paired_here")


def library_size(pairs: int, unique: int) -> int | None:
    """Molecules x of a library with unique / x - 1 + exp(-pairs / x) = 0; None without duplicates."""
    if pairs <= unique or unique <= 0:
        return None
    f = lambda x: unique / x - 1 + math.exp(-pairs / x)
    low, high = 1.0, 100.0
    while f(high * unique) > 0:
        high *= 10
    for _ in range(40):
        middle = (low + high) / 2
        value = f(middle * unique)
        if value == 0:
            break
        low, high = (middle, high) if value > 0 else (low, middle)
    return int(unique * (low + high) / 2)


def library_sizes(counts: DataFrame) -> DataFrame:
    """(library, pairs, unique, library_size) of (library, pairs, unique), a row a library."""
    import pandas as pd

    def sized(batches):
        for rows in batches:
            found = [library_size(int(p), int(u)) for p, u in zip(rows["pairs"], rows["unique"], strict=True)]
            yield rows.assign(library_size=pd.array(found, "Int64"))

    return counts.mapInPandas(sized, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in counts.schema)}, library_size long")


def return_curve(sizes: DataFrame, times: int = 10) -> DataFrame:
    """(library, times, share): unique molecules at `times` the sequencing over those now, for libraries of `library_sizes`."""
    each = sizes.where("library_size IS NOT NULL").select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("times"))
    share = F.col("library_size") * (1 - F.exp(-F.col("times") * F.col("pairs") / F.col("library_size"))) / F.col("unique")
    return each.select("library", "times", F.round(share, 6).alias("share"))


def return_on_investment(size: int, pairs: int, unique: int, times: int = 100) -> list[tuple[int, float]]:
    """(x, unique molecules at x times the sequencing over those now)."""
    return [(x, size * (1 - math.exp(-x * pairs / size)) / unique) for x in range(1, times + 1)]


def insert_metrics(reads: DataFrame, deviations: float = 10.0) -> DataFrame:
    """Insert sizes by orientation: median, MAD, and mean and sd of those within `deviations` MADs."""
    rows = reads.where("insert_size <> 0").withColumn("size", F.abs("insert_size"))
    counts = rows.groupBy("orientation", "size").agg(F.count("*").alias("n"))
    medians = counts.groupBy("orientation").agg(F.expr("percentile(size, 0.5, n)").alias("median"))
    spread = counts.join(F.broadcast(medians), "orientation").withColumn("dev", F.abs(F.col("size") - F.col("median")))
    mads = spread.groupBy("orientation").agg(F.expr("percentile(dev, 0.5, n)").alias("mad"))
    inside = spread.join(F.broadcast(mads), "orientation").where(F.col("size") <= F.col("median") + deviations * F.col("mad"))
    n, s, q = F.sum("n"), F.sum(F.col("size") * F.col("n")), F.sum(F.col("size").cast("long") * F.col("size") * F.col("n"))
    # squares of sums outgrow a long from some ten million reads on
    whole = lambda c: c.cast("decimal(19,0)")
    squares = (whole(n) * whole(q) - whole(s) * whole(s)).cast("double") / n
    return inside.groupBy("orientation").agg(
        F.first("median").alias("median"), F.first("mad").alias("mad"), n.alias("n"), F.round(s / n, 6).alias("mean"), F.round(F.sqrt(squares / F.nullif(n - 1, F.lit(0))), 6).alias("sd")
    )


def alignment_summary(reads: DataFrame) -> DataFrame:
    """Totals by place in the pair: reads, aligned, of good quality, with bad mates, by strand."""
    return reads.where(~flagged(SECONDARY)).groupBy(F.when(flagged(1), F.when(flagged(FIRST), "FIRST").otherwise("SECOND")).otherwise("UNPAIRED").alias("category")).agg(
        F.count("*").alias("total"),
        F.count_if(~flagged(4)).alias("aligned"),
        F.count_if(~flagged(4) & (F.col("mapq") >= 20)).alias("good"),
        F.count_if(flagged(8)).alias("mate_unmapped"),
        F.round(F.avg((~flagged(16)).cast("int")), 6).alias("strand_balance"),
    )


def coverage_metrics(depths: DataFrame, contig_lengths: DataFrame, cap: int, levels: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean, sd and median of capped coverage and the share of the genome at each level.

    depths: (contig, pos, depth); positions without a row are covered by none.
    """
    genome = contig_lengths.agg(F.sum("length").alias("size"))
    counts = depths.groupBy(F.least("depth", F.lit(cap)).alias("bin")).agg(F.count("*").alias("n"))
    zero = genome.join(F.broadcast(depths.agg(F.count("*").alias("covered")))).select(F.lit(0).cast("long").alias("bin"), (F.col("size") - F.col("covered")).alias("n"))
    every = counts.select(F.col("bin").cast("long").alias("bin"), "n").unionByName(zero).groupBy("bin").agg(F.sum("n").alias("n"))
    n, s, q = F.sum("n"), F.sum(F.col("bin") * F.col("n")), F.sum(F.col("bin") * F.col("bin") * F.col("n"))
    return every.agg(
        n.alias("size"),
        F.round(s / n, 6).alias("mean"),
        F.round(F.sqrt((q - s * s / n) / (n - 1)), 6).alias("sd"),
        F.expr("percentile(bin, 0.5, n)").alias("median"),
        *[F.round(F.sum(F.when(F.col("bin") >= k, F.col("n")).otherwise(0)) / n, 9).alias(f"at_{k}x") for k in levels],
    )


def quality_by_cycle(reads: DataFrame) -> DataFrame:
    """Mean phred of each read place, in sequencing order."""
    ordered = F.when(flagged(16), F.reverse("qual")).otherwise(F.col("qual"))
    each = reads.select(F.posexplode(F.split(ordered, "")).alias("cycle", "q"))
    return each.groupBy((F.col("cycle") + 1).alias("cycle")).agg(F.round(F.avg(F.ascii("q") - 33), 6).alias("mean_phred"), F.count("*").alias("n"))


def quality_distribution(reads: DataFrame) -> DataFrame:
    each = reads.select(F.explode(F.split("qual", "")).alias("q"))
    return each.groupBy((F.ascii("q") - 33).alias("phred")).agg(F.count("*").alias("n"))


def gc_share(seq) -> F.Column:
    """Share of G and C among A, C, G and T; null without any."""
    gc = F.length(F.regexp_replace(seq, "[^GC]", ""))
    return F.try_divide(gc, F.length(F.regexp_replace(seq, "[^ACGT]", "")))


def gc_windows(starts: DataFrame, chunks: DataFrame, window: int = 100) -> DataFrame:
    """Windows and read starts by GC percent of the reference."""
    parts = chunks.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / window).cast("int") - 1))).where("k >= 0")
    gc = F.floor(gc_share(F.substr("seq", F.col("k") * window + 1, F.lit(window))) * 100)
    windows = parts.select("contig", (F.col("chunk") * 10_000 / window + F.col("k")).cast("long").alias("w"), gc.alias("gc")).where("gc IS NOT NULL")
    hits = starts.groupBy("contig", F.floor(F.col("pos") / window).alias("w")).agg(F.count("*").alias("starts"))
    return windows.join(hits, ["contig", "w"], "left").groupBy("gc").agg(F.count("*").alias("windows"), F.coalesce(F.sum("starts"), F.lit(0)).alias("starts"))


def tolerant_groups(counts: DataFrame, length: int) -> DataFrame:
    """(leader, n) of counted strings (prefix, n): each goes to the smallest one within a mismatch of it.

    Strings within a mismatch share a key in which one letter is left open, so they meet by equality.
    """
    keys = F.array(*[F.concat(F.substring("prefix", 1, k - 1), F.lit("_"), F.substr("prefix", F.lit(k + 1))) for k in range(1, length + 1)])
    each = counts.select("prefix", "n", F.explode(keys).alias("key"))
    low = each.groupBy("key").agg(F.min("prefix").alias("low"))
    led = each.join(low, "key").groupBy("prefix").agg(F.first("n").alias("n"), F.min("low").alias("leader"))
    return led.groupBy("leader").agg(F.sum("n").alias("n"))


def bisulfite_converted(seq: Column, wt: Column, negative: Column) -> Column:
    """Whether a base may be the reference's after bisulfite: T for C on the forward strand, A for G on the other."""
    return F.when(negative, (wt == "G") & (seq == "A")).otherwise((wt == "C") & (seq == "T"))


def edit_distance(shown: DataFrame, key: list[str], negative: str | None = None) -> DataFrame:
    """Mismatches of each read, and with inserted and deleted letters its distance from the reference.

    With `negative`, a column that tells the strand, reads are bisulfite treated: conversions are no mismatches.
    """
    differs = F.col("kind") == "SUBSTITUTION"
    if negative is not None:
        differs = differs & ~bisulfite_converted(F.col("seq"), F.col("wt"), F.col(negative))
    mismatches = F.count_if(differs)
    inserted = F.coalesce(F.sum(F.when(F.col("kind") == "INSERTION", F.length("seq"))), F.lit(0))
    return shown.groupBy(*key).agg(mismatches.alias("mismatches"), (mismatches + inserted + F.count_if(F.col("kind") == "DELETION")).alias("nm"))


def target_metrics(coverage: DataFrame, targets: DataFrame) -> DataFrame:
    """Coverage on and off target, its share on target, and targets without any."""
    hits = intervals.inside(coverage.select("contig", "pos"), targets).withColumn("hit", F.lit(True))
    marked = coverage.join(hits, ["contig", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    on, off = F.sum(F.when(F.col("hit"), F.col("value"))), F.sum(F.when(~F.col("hit"), F.col("value")))
    totals = marked.agg(on.alias("on_target"), off.alias("off_target"), F.round(on / F.sum("value"), 9).alias("selected"))
    names = targets.select("name").distinct().agg(F.count("*").alias("targets"))
    reached = intervals.touched(targets, coverage.select("contig", "pos")).agg(F.count("*").alias("reached"))
    return totals.join(F.broadcast(names)).join(F.broadcast(reached)).withColumn("untouched", F.col("targets") - F.col("reached")).drop("reached")


def capture_bases(coverage: DataFrame, baits: DataFrame, near: int = 250) -> DataFrame:
    """(kind, bases): covered bases ON a bait, NEAR one (within `near` places), and OFF all baits."""
    kinds = baits.select("contig", "start", "end", F.lit("ON").alias("kind")).union(baits.select("contig", F.col("start") - near, F.col("end") + near, F.lit("NEAR")))
    return transcripts.swept(coverage, kinds, ("ON", "NEAR", "OFF"))


def target_coverage(coverage: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, contig, start, end, length, total, mean) of each target, without any coverage too."""
    keys = targets.select("name", "contig", "start", "end")
    sums = intervals.overlapping(coverage, keys).groupBy("name").agg(F.sum("value").alias("total"))
    length = F.col("end") - F.col("start") + 1
    return keys.join(sums, "name", "left").select(*keys.columns, length.alias("length"), F.coalesce("total", F.lit(0)).alias("total"), F.round(F.coalesce("total", F.lit(0)) / length, 6).alias("mean"))


def evenness(coverage: DataFrame, targets: DataFrame) -> DataFrame:
    """One row (bases, mean, p20, fold_80): how much more sequencing would bring 80 % of target bases to the mean.

    Places of targets are counted by depth, those without coverage as 0; the 20th percentile comes from the counts.
    """
    keys = targets.select("name", "contig", "start", "end")
    sizes = keys.agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    counts = intervals.overlapping(coverage, keys).groupBy("value").agg(F.count("*").alias("n"))
    seen = counts.agg(F.sum("n").alias("covered"), F.sum(F.col("n") * F.col("value")).alias("total"))
    bases, covered, total = (sizes.first()[0] or 0, *(v or 0 for v in seen.first()))
    rank = bases // 5  # place of the percentile among all places, from 0
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # one row for each depth
    below = counts.withColumn("upto", F.sum("n").over(upto) + (bases - covered)).where(F.col("upto") > rank).agg(F.min("value").alias("v"))
    p20 = F.when(F.lit(rank < bases - covered), F.lit(0).cast("long")).otherwise(F.col("v"))
    mean = total / bases if bases else None
    return below.select(F.lit(bases).cast("long").alias("bases"), F.round(F.lit(mean).cast("double"), 6).alias("mean"), p20.alias("p20"), F.round(F.try_divide(F.lit(mean).cast("double"), p20), 6).alias("fold_80"))


def gc_dropout(targets: DataFrame) -> DataFrame:
    """One row (at_dropout, gc_dropout) of targets (gc in percent, length, total): shares of bases that coverage falls short of.

    By percent of G and C: what a class has of all bases, less what it has of all coverage, where that is
    positive; summed up to 50 % and above.
    """
    classes = targets.where("gc IS NOT NULL").groupBy("gc").agg(F.sum("length").alias("length"), F.sum("total").alias("total"))
    sums = classes.agg(F.sum("length").alias("all_length"), F.sum("total").alias("all_total"))
    short = F.greatest(F.col("length") / F.col("all_length") - F.coalesce(F.try_divide(F.col("total"), F.col("all_total")), F.lit(0.0)), F.lit(0.0)) * 100
    rows = classes.join(F.broadcast(sums)).select("gc", short.alias("short"))
    part = lambda own: F.round(F.coalesce(F.sum(F.when(own, F.col("short"))), F.lit(0.0)), 6)
    return rows.agg(part(F.col("gc") <= 50).alias("at_dropout"), part(F.col("gc") > 50).alias("gc_dropout"))


def banded_pairs(rows: DataFrame, text: str, length: int, mismatches: int, keys: list[str], name: str = "id") -> DataFrame:
    """(a, b), each pair of equal `keys` once, whose texts of `length` letters differ in `mismatches` of them at most.

    Of mismatches + 1 bands of the texts one is equal; a pair is given where its first equal band is.
    """
    bands = mismatches + 1
    edges = [round(length * k / bands) for k in range(bands + 1)]
    cuts = F.array(*[F.substring(text, a + 1, z - a) for a, z in zip(edges, edges[1:], strict=False)])
    held = rows.select(*keys, F.col(name).alias("id"), F.col(text).alias("t"), cuts.alias("cuts")).select("*", F.posexplode("cuts").alias("band", "part"))
    other = held.select(*keys, "band", "part", F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("cuts").alias("__cuts"))
    met = held.join(other, [*keys, "band", "part"]).where(F.col("id") < F.col("__id"))
    first = F.array_position(F.zip_with("cuts", "__cuts", lambda x, y: x == y), True) == F.col("band") + 1
    apart = F.aggregate(F.zip_with(F.split("t", ""), F.split("__t", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, d: acc + d)
    return met.where(first & (apart <= mismatches)).select(F.col("id").alias("a"), F.col("__id").alias("b"))


def pair_complexity(pairs: DataFrame, length: int, identical: int = 5, rate: float = 0.03) -> DataFrame:
    """(leader, n): read pairs (first, second) as groups of copies, by both ends' first `length` letters.

    Pairs may be copies if the first `identical` letters of both ends agree, and all letters of both together
    but a share of `rate`. In the order of their counts, then letters, each joins the first earlier one that it may be a copy of
    and that is no copy itself, or leads a group. Equal pairs are counted before they meet others.
    """
    cut_ = lambda c: F.substring(c, 1, length)
    counts = pairs.where((F.length("first") >= length) & (F.length("second") >= length)).groupBy(F.concat(cut_("first"), cut_("second")).alias("id")).agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("start", F.concat(F.substring("id", 1, identical), F.substring("id", length + 1, identical))))
    links = banded_pairs(counts, "id", 2 * length, int(2 * length * rate), ["start"])
    order = lambda k: counts.select(F.col("id").alias(k), F.struct((-F.col("n")).alias("n"), "id").alias(f"rank_{k}"))
    both = links.join(order("a"), "a").join(order("b"), "b")
    first = F.col("rank_a") < F.col("rank_b")
    later = cut(both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.least("rank_a", "rank_b").alias("rank")))
    kept = molecules.leaders(later)
    joined = later.join(kept, later["u"] == kept["node"], "left_semi").groupBy(F.col("v").alias("id")).agg(F.min_by("u", "rank").alias("leader"))
    return counts.join(joined, "id", "left").groupBy(F.coalesce("leader", "id").alias("leader")).agg(F.sum("n").alias("n"))


def assigned_barcodes(reads: DataFrame, sheet: DataFrame, length: int, mismatches: int = 1, margin: int = 1, no_calls: int = 2) -> DataFrame:
    """Reads (code) with `sample` of the sheet (sample, code): the one that fits best, null unless it fits clearly.

    A sample fits with at most `mismatches` letters that differ, N being no call and no mismatch; a read with
    more than `no_calls` of them has none. The next best one must have `margin` more mismatches. Distinct codes meet the sheet
    by bands: of all samples that matter, one of the bands has neither a mismatch nor an N.
    """
    bands = mismatches + margin - 1 + no_calls + 1
    edges = [round(length * k / bands) for k in range(bands + 1)]
    cuts = lambda c: F.array(*[F.struct(F.lit(k).alias("band"), F.substring(c, a + 1, z - a).alias("part")) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))])
    codes = reads.select("code").distinct().where(F.length(F.regexp_replace("code", "[^N]", "")) <= no_calls)
    left = codes.select("code", F.explode(cuts("code")).alias("x")).select("code", "x.*")
    right = sheet.select("sample", F.col("code").alias("own"), F.explode(cuts("code")).alias("x")).select("sample", "own", "x.*")
    met = left.join(right, ["band", "part"]).select("code", "sample", "own").distinct()
    apart = F.aggregate(F.zip_with(F.split("code", ""), F.split("own", ""), lambda x, y: ((x != y) & (x != "N")).cast("int")), F.lit(0), lambda acc, d: acc + d)
    ranked = met.select("code", F.struct(apart.alias("apart"), "sample").alias("fit")).groupBy("code").agg(F.min("fit").alias("best"), F.array_sort(F.collect_list(F.col("fit.apart"))).alias("all"))
    clear = (F.col("best.apart") <= mismatches) & (F.coalesce(F.get("all", F.lit(1)), F.lit(length + margin)) - F.col("best.apart") >= margin)
    return reads.join(ranked.where(clear).select("code", F.col("best.sample").alias("sample"), F.col("best.apart").alias("mismatches")), "code", "left")


def multi_level(reads: DataFrame, levels: list[list[str]], keys: list[str]) -> DataFrame:
    """One metric at several levels of accumulation at once."""
    return reads.groupingSets([[*level] for level in levels], *keys).agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq_sum"), F.grouping_id().alias("level"))


def downsample(reads: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A share of names; mates share the decision; secondary and supplementary records are dropped first."""
    kept = reads.where(~flagged(SECONDARY) & ~flagged(SUPPLEMENTARY))
    return kept.where(drawn(seed, F.col("qname")) < int(share * 1_000_000))


def compare(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Counts of matches, mismatches and rows that only one side has."""
    left = a.select(*key, F.struct(*values).alias("va"), F.lit(True).alias("in_a"))
    right = b.select(*key, F.struct(*values).alias("vb"), F.lit(True).alias("in_b"))
    both = left.join(right, key, "full")
    outcome = F.when(F.col("in_a").isNull(), "only_second").when(F.col("in_b").isNull(), "only_first").when(F.col("va").eqNullSafe(F.col("vb")), "match").otherwise("differ")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def validate(reads: DataFrame) -> DataFrame:
    """Counts of records by what is wrong with them."""
    checks = {
        "MATE_FLAGS_ON_UNPAIRED": ~flagged(1) & (F.col("flag").bitwiseAND(F.lit(2 | 8 | 32 | 64 | 128)) != 0),
        "SEQ_QUAL_LENGTH": F.length("seq") != F.length("qual"),
        "MAPQ_ON_UNMAPPED": flagged(4) & (F.col("mapq") != 0),
        "NEGATIVE_START": F.col("start") < 0,
        "MISSING_CIGAR": ~flagged(4) & (F.coalesce("cigar", F.lit("*")) == "*"),
    }
    each = reads.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda n: n.isNotNull())).alias("problem"))
    return each.groupBy("problem").agg(F.count("*").alias("n"))


def clean(reads: DataFrame) -> DataFrame:
    """Unmapped records get mapping quality 0."""
    return reads.withColumn("mapq", F.when(flagged(4), 0).otherwise(F.col("mapq")))


def to_fastq(reads: DataFrame) -> DataFrame:
    """(qname, first, record): reads in sequencing order as FASTQ records."""
    from ..functions.sequence import reverse_complement

    primary = reads.where(~flagged(SECONDARY) & ~flagged(SUPPLEMENTARY))
    seq = F.when(flagged(16), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(flagged(16), F.reverse("qual")).otherwise(F.col("qual"))
    return primary.select("qname", flagged(FIRST).alias("first"), F.concat(F.lit("@"), "qname", F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("record"))


def revert(reads: DataFrame) -> DataFrame:
    """Alignments taken back: unmapped reads in sequencing order."""
    from ..functions.sequence import reverse_complement

    seq = F.when(flagged(16), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(flagged(16), F.reverse("qual")).otherwise(F.col("qual"))
    kept = F.col("flag").bitwiseAND(F.lit(1 | 64 | 128)).bitwiseOR(F.lit(4))
    return reads.where(~flagged(SECONDARY)).withColumns(
        {"seq": seq, "qual": qual, "flag": kept, "mapq": F.lit(0), "cigar": F.lit("*"), "start": F.lit(-1), "contig": F.lit("*")}
    )


def extract_sequences(intervals: DataFrame, chunks: DataFrame, size: int = 10_000) -> DataFrame:
    """Reference letters of each interval, joined over its chunks; beyond the known letters there are none."""
    parts = intervals.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor(F.col("end") / size).cast("int"))))
    low = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk") * size, F.lit(size - 1))
    pieces = parts.join(chunks, ["contig", "chunk"], "left").select("name", "chunk", F.coalesce(F.substr("seq", low + 1, high - low + 1), F.lit("")).alias("s"))
    return pieces.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda p: p["s"]), "").alias("seq"))


def quality_encoding(lowest: int, highest: int) -> str:
    """Offset that a range of quality characters tells: standard, old or unknown."""
    if lowest < 59:
        return "STANDARD"
    if lowest >= 64 and highest > 74:
        return "ILLUMINA"
    return "SOLEXA" if lowest < 64 and highest > 74 else "UNKNOWN"


def filter_names(reads: DataFrame, names: DataFrame, include: bool = True) -> DataFrame:
    """Reads whose name is (or isn't) in a list (qname)."""
    return reads.join(names.select("qname").distinct(), "qname", "left_semi" if include else "left_anti")


def reordered(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads in the contig order of another reference (contig, place); reads of other contigs are dropped."""
    return reads.join(contigs, "contig").repartitionByRange("place", "start").sortWithinPartitions("place", "start")


def fixed_mates(reads: DataFrame, key: list[str]) -> DataFrame:
    """Mate columns taken from the mate itself; null without one."""
    from .reads import with_mates

    return with_mates(reads.drop("mate_start", "mate_mapq", "mate_cigar"), key)


def with_read_group(reads: DataFrame, group: str) -> DataFrame:
    """Reads with their RG tag replaced."""
    others = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k != "RG")
    return reads.withColumn("tags", F.map_concat(others, F.create_map(F.lit("RG"), F.lit(group))))


def with_alignment(unmapped: DataFrame, aligned: DataFrame) -> DataFrame:
    """Unmapped reads with the alignment of the same name and place in the pair, where there is one."""
    found = aligned.select("qname", "is_first", "contig", "start", "mapq", "cigar")
    return unmapped.drop("contig", "start", "mapq", "cigar").join(found, ["qname", "is_first"], "left")
