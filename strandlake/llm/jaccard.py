"""Exact links between texts whose sets of word shingles have a Jaccard similarity of a bound or more.

The completion of a SimHash join: fingerprints of a fixed radius miss similar texts, so the links that
they give are verified here, and a prefix-filtered join finds what is left. Shingles have one global
order; of two sets with similarity p or more, the first n - ceil(p n) + 1 shingles of each share one.
Only these prefixes are dealt out by shingle, with places: a pair is made only where both sets
have enough left from the shingle on, as they must from their first common one. Shingles that a sample of the texts has often come last,
so that prefixes hold few common ones; the rest are ordered by hash. Any order gives the same pairs.

Every text meets a few leaders of each of its shingles first, and after that only texts that are still
outside of the shingle's largest component meet the others. The closure is that of all pairs. Where that
would be over `PAIRS` pairs of a shingle, no pairs are made: such shingles' texts form families, whose
sets are compared exactly block against block, and a block pair gives a spanning forest of its links.
A family is made only where it has no more pairs than its shingles had; else each shingle is one.

Candidates are filtered by the Manhattan distance of the sets' counts over bins of hashes (a bin for
about `PER_BIN` shingles), a lower bound of their difference, before whole sets are fetched and
compared. So sets are fetched twice, and of texts that are likely to be similar only.

Defined results: words are lower-cased and split at ASCII spaces; a text of no more words than a
shingle is one shingle; all wordless and null texts are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .batches import CHUNK_BYTES, chunks, small_batches
from .components import components

SEED = 42
LEADERS = 2
PER_BIN, FEWEST_BINS, MOST_BINS = 4, 32, 1 << 14
#: Keys of wanted texts up to which they are broadcast, so that texts are not shuffled to be chosen.
BROADCAST = 1 << 19
#: Texts of one in so many are sampled; so many of them make a shingle common; so many are known at most.
SAMPLED, OFTEN, MOST_COMMON = 16, 8, 200_000
#: Words of at most so many bytes, and so many of them, whose hashes a worker remembers.
REMEMBERED_SIZE, REMEMBERED = 32, 200_000
#: Pairs of a shingle up to which they are made by a join.
PAIRS = 1 << 16
#: Texts and shingles of a block, about; shingles that are counted at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 2048, 1 << 18, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, SEED)
    if len(word) <= REMEMBERED_SIZE:
        _known[word] = value
    return value


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Unsigned 64-bit hashes of a text's shingles, repeats included: words are hashed once, then mixed in order."""
    words = (text or b"").lower().split()
    if len(_known) > REMEMBERED:
        _known.clear()
    each = np.fromiter((_known.get(w) or _word_hash(w) for w in words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    value = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        value = (value ^ (value >> np.uint64(29))) * _MIX + each[k : k + n]
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _of_texts(texts: DataFrame, function: Callable[[bytes | None], tuple], schema: str, fields: list[pa.Field]) -> DataFrame:
    """(t, values of `function`) for every row of (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values in chunks(batch.column(1), CHUNK_BYTES):
                made = list(zip(*map(function, values), strict=True))
                arrays = [pa.array(list(v), type=f.type) for v, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(values)), *arrays], names=["t", *[f.name for f in fields]])

    small_batches(texts)
    return texts.select("t", F.col("text").cast("binary")).mapInArrow(run, f"t long, {schema}")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(t, s): the distinct shingles of each text."""
    one = lambda text: (np.unique(shingle_hashes(text, size)).view(np.int64),)
    return _of_texts(texts, one, "s array<long>", [pa.field("s", pa.list_(pa.int64()))])


def common_shingles(texts: DataFrame, size: int) -> list[int]:
    """Shingles that many texts have, as far as a sample of texts tells."""
    some = _sets(texts.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLED)) == 0), size).select("t", F.explode("s").alias("g"))
    counts = some.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return [r["g"] for r in counts.orderBy(F.desc("n"), "g").limit(MOST_COMMON).select("g").collect()]


def profiles(texts: DataFrame, size: int, percent: int, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(t, n, prefix, bins, fp) of each distinct text: its number of shingles, their prefix, counts by bin, and a fingerprint."""
    last = texts.sparkSession.sparkContext.broadcast(np.array(sorted(common_shingles(texts, size)), np.int64))

    def one(text: bytes | None) -> tuple:
        every = shingle_hashes(text, size)
        own = np.unique(every)
        signed = own.view(np.int64)
        if len(last.value):
            place = np.minimum(np.searchsorted(last.value, signed), len(last.value) - 1)
            signed = signed[np.argsort(last.value[place] == signed, kind="stable")]
        size_of = min(MOST_BINS, max(FEWEST_BINS, 1 << (len(own) // PER_BIN).bit_length()))
        bins = np.minimum(np.bincount((own >> np.uint64(32)).astype(np.int64) & (size_of - 1), minlength=size_of), 32767)
        return len(own), signed[: prefix_length(len(own), percent)], bins.astype(np.int16), fingerprint(every)

    fields = [pa.field("n", pa.int32()), pa.field("prefix", pa.list_(pa.int64())), pa.field("bins", pa.list_(pa.int16())), pa.field("fp", pa.int64())]
    made = _of_texts(texts, one, "n int, prefix array<long>, bins array<short>, fp long", fields)
    return cut(made.groupBy("t").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "bins", "fp")]))


def plausible(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, whose sizes and counts by bin allow the similarity."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    a, b = (made.select(F.col("t").alias(k), F.col("n").alias(f"n_{k}"), F.col("bins").alias(f"bins_{k}")) for k in "ab")
    both = ordered.join(a, "a").join(b, "b").where(_sized(F.col("n_a"), F.col("n_b"), percent))

    def folded(own: str, other: str) -> Column:
        """Counts over half as many bins where the other set has fewer; sizes that fit differ by one doubling at most."""
        half = F.floor(F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: (x + y).cast("short"))).otherwise(F.col(own))

    bins = F.zip_with(folded("bins_a", "bins_b"), folded("bins_b", "bins_a"), lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    apart = F.aggregate(bins, F.lit(0), lambda acc, d: acc + d)
    return both.where(apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b")


def _sized(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _within_reach(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles whose first common one is at places i and j (from 0) can share enough: no more than what follows there."""
    most = F.least(n - i, m - j).cast("long")
    return _sized(n, m, percent) & (most * (100 + percent) >= (n.cast("long") + m) * percent)


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, text) of the `wanted` keys (t), which are distinct and already cut: one row each. Few keys are broadcast, so texts stay where they are."""
    few = wanted.count() <= BROADCAST
    return texts.join(F.broadcast(wanted) if few else wanted, "t", "left_semi").groupBy("t").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), already cut, whose sets really have the similarity."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    sets = cut(_sets(fetched(texts, wanted), size))
    left, right = (sets.select(F.col("t").alias(k), F.col("s").alias(f"s_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    enough = shared * (100 + percent) >= percent * (F.size("s_a") + F.size("s_b"))
    return cut(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"))


def _rooted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (t, ...) with the component of each text."""
    roots = components(known).select(F.col("node").alias("t"), "root")
    return rows.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))


def complete(texts: DataFrame, made: DataFrame, first: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(a, b) keys that span the graph of texts (t, text) with a similarity of percent / 100 or more.

    made: their profiles. first: pairs that may be links, as many as another method found.
    """
    dealt = made.select("t", "n", F.posexplode("prefix").alias("i", "g"))
    members = cut(dealt.withColumn("many", F.count("*").over(Window.partitionBy("g"))).where("many > 1").select("g", "t", "n", "i"))

    # places count as if a pair's shingle were its first common one: so it is in one of the rows of each similar pair
    heads = members.groupBy("g").agg(*[F.min_by(F.struct("t", "n", "i"), F.xxhash64("t", F.lit(k))).alias(f"h{k}") for k in range(LEADERS)])
    led = members.join(heads, "g").select("t", "n", "i", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(LEADERS)]))).alias("h"))
    met = led.where(_within_reach(F.col("n"), F.col("i"), F.col("h.n"), F.col("h.i"), percent)).select(F.col("t").alias("a"), F.col("h.t").alias("b"))
    tested = cut(plausible(first.union(met), made, percent))
    known = verified(tested, texts, size, percent)

    rooted = cut(_rooted(members, known).select("g", "t", "n", "i", "root"))
    sizes = rooted.groupBy("g", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("g").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("parts"), F.sum("c").alias("all")).where("parts > 1")
    dense = F.col("all") * (F.col("all") - F.col("top.c")) > PAIRS
    marked = rooted.join(main.select("g", F.col("top.root").alias("top"), dense.alias("dense")), "g")
    sparse = marked.where("NOT dense")
    outside = sparse.where("root <> top").select("g", F.col("t").alias("a"), F.col("n").alias("k"), F.col("i").alias("at"), F.col("root").alias("own"))
    inside = sparse.select("g", F.col("t").alias("b"), "n", "i", "root", (F.col("root") == F.col("top")).alias("in_top"))
    reach = _within_reach(F.col("k"), F.col("at"), F.col("n"), F.col("i"), percent)
    late = outside.join(inside, "g").where((F.col("own") != F.col("root")) & (F.col("in_top") | (F.col("a") < F.col("b"))) & reach)
    fresh = cut(plausible(late.select("a", "b"), made, percent).join(tested, ["a", "b"], "left_anti"))
    found = known.union(verified(fresh, texts, size, percent))
    crowded = cut(marked.where("dense").select("g", "t", "n", (F.col("root") != F.col("top")).alias("out")))
    return found if crowded.isEmpty() else found.union(_family_links(crowded, texts, size, percent))


def _family_links(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span those of texts, one of them `out`, which share a shingle in `rows` (g, t, n, out)."""
    heads = rows.groupBy("g").agg(F.min("t").alias("head"), F.count("*").alias("all"), F.count_if("out").alias("outs"))
    tied = rows.join(heads, "g")
    roots = components(tied.select(F.col("t").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("head"), F.col("root").alias("family"))
    shingles = heads.join(roots, "head").select("g", "family", (F.col("all") * F.col("outs")).alias("pairs"))
    whole = rows.join(shingles, "g").groupBy("family", "t").agg(F.max("n").alias("n"), F.max("out").alias("out"))
    cost = whole.groupBy("family").agg((F.count("*") * F.count_if("out")).alias("cost"))
    cheaper = shingles.groupBy("family").agg(F.sum("pairs").alias("pairs")).join(cost, "family").where("cost <= pairs").select("family")
    chosen = shingles.join(cheaper.withColumn("whole", F.lit(True)), "family", "left").select("g", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole"), F.col("family")).otherwise(F.col("g")).alias("f"))
    own = cut(rows.join(chosen, "g").groupBy("whole", "f", "t").agg(F.max("n").alias("n"), F.max("out").alias("out")))

    parts = lambda out: F.ceil(F.greatest(F.count_if(out) / BLOCK_TEXTS, F.sum(F.when(out, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = own.groupBy("whole", "f").agg(parts(F.col("out")).alias("outer"), parts(~F.col("out")).alias("inner"))
    once = fetched(texts, cut(own.select("t").distinct()))
    placed = own.join(blocks, ["whole", "f"]).withColumn("own", F.when(F.col("out"), F.pmod(F.xxhash64("t"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("t"), F.greatest("inner", F.lit(1)))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    spread = placed.join(_sets(once, size), "t").select("whole", "f", "t", "s", "own", F.explode(others).alias("other"))
    paired = spread.select("whole", "f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "s")

    def linked(table: pa.Table) -> pa.Table:
        t, block = (table.column(c).to_numpy() for c in ("t", "own"))
        lists = table.column("s").combine_chunks()
        found = forest(similar(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), block == block.min(), percent))
        return pa.table({"a": pa.array(t[found[:, 0]], pa.int64()), "b": pa.array(t[found[:, 1]], pa.int64())})

    return cut(paired.groupBy("whole", "f", "i", "j").applyInArrow(linked, "a long, b long"))


def similar(shingles: np.ndarray, sizes: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, given one after the other, have the similarity: of first with others, or of all if all are first."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
    # a shingle of one set is in no intersection
    kept = times[column] > 1
    row, column = row[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one, other = np.flatnonzero(first), np.arange(len(sizes)) if first.all() else np.flatnonzero(~first)
    shared = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[row[a:z], column[a:z] - low] = 1
        shared += has[one] @ has[other].T
    near = np.zeros((len(sizes), len(sizes)), bool)
    near[np.ix_(one, other)] = shared.astype(np.int64) * (100 + percent) >= percent * (sizes[one].astype(np.int64)[:, None] + sizes[other])
    near |= near.T
    np.fill_diagonal(near, False)
    return near


def forest(near: np.ndarray) -> np.ndarray:
    """Edges (k, 2) of a spanning forest of a symmetric matrix."""
    left, edges = np.ones(len(near), bool), [np.zeros((0, 2), np.int64)]
    for begin in range(len(near)):
        frontier = [begin] if left[begin] else []
        left[begin] = False
        while frontier:
            node = frontier.pop()
            hit = np.flatnonzero(near[node] & left)
            left[hit] = False
            frontier.extend(hit.tolist())
            edges.append(np.column_stack((np.full(len(hit), node), hit)))
    return np.concatenate(edges)
