"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints, so pairs within Hamming
distance r are found by a grid join on the embedding and then verified exactly.

Grid: the segments are dealt into g groups. Two embeddings within Manhattan distance r agree in at
least g - r groups, so every fingerprint is put into one cell for each choice of g - r groups, and a
qualifying pair shares a cell. Cells of more than `DENSE` fingerprints (near copies in thousands)
are joined block against block, each block pair giving a spanning forest instead of its pairs.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal
fingerprints form one class; repeated rows stay repeated; a null doc_id is never a smallest id
unless its whole component has none; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import jaccard
from .batches import with_columns
from .components import components

SEED = 42
DENSE = 48
BLOCK = 1024
EVEN_BITS = 0x5555555555555555


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: bits that are set in over half of the hashes."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints_of(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts: majority of the bits of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text or b"").split()
        if not words:
            continue
        line = b" ".join(words).lower()
        if len(words) <= shingle:
            hashes = np.array([digest(line, SEED)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-shingle]))
            hashes = np.fromiter(
                (digest(line[a:z], SEED) for a, z in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)),
                np.uint64,
                len(starts),
            )
        out[k] = majority(hashes)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""
    made = with_columns(docs, text, lambda values: {"fp": fingerprints_of(values, shingle)}, "fp long", [doc_id])
    return made.withColumnRenamed(doc_id, "doc_id")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits of a long."""
    next_bit = F.shiftrightunsigned(fp, 1)
    ones = fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(EVEN_BITS))
    twos = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(EVEN_BITS))
    return ones.bitwiseOR(F.shiftleft(twos, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings, from the sums over groups of segments.

    Counts are spread to four bits and offset by four, so that differences stay in their fields.
    """
    low, four = F.lit(0x3333333333333333), F.lit(0x4444444444444444)
    total = None
    for shift in (0, 2):
        x, y = (F.shiftrightunsigned(v, shift).bitwiseAND(low) for v in (a, b))
        d = (x.bitwiseOR(four)) - y
        # a field holds 2..6; 4 means equal, 3 and 5 differ by one, 2 and 6 by two
        odd = d.bitwiseAND(F.lit(0x1111111111111111))
        two = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(0x1111111111111111)).bitwiseAND(F.bitwise_not(odd))
        part = F.bit_count(odd) + 2 * F.bit_count(two)
        total = part if total is None else total + part
    return total


def cell_masks(groups: int, radius: int) -> list[int]:
    """Bit masks over the packed embedding, one for each choice of groups that must agree."""
    edges = [round(32 * k / groups) for k in range(groups + 1)]
    part = [sum(0b11 << (2 * s) for s in range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]
    masks = [sum(part[k] for k in choice) for choice in combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def grid_groups(rows: int, radius: int) -> int:
    """Groups that keep cells small: more groups, hence finer cells, for more fingerprints."""
    return radius + 3 + max(0, (max(rows, 1).bit_length() - 22) // 4)


def bounds_of(fps: np.ndarray, one: np.uint64) -> np.ndarray:
    """Manhattan distances of the embeddings of `fps` from that of `one`, in numpy."""
    even, low, field = np.uint64(EVEN_BITS), np.uint64(0x3333333333333333), np.uint64(0x1111111111111111)

    def packed(v: np.ndarray) -> np.ndarray:
        nxt = v >> np.uint64(1)
        return ((v ^ nxt) & even) | ((v & nxt & even) << np.uint64(1))

    total = np.zeros(len(fps), np.int64)
    for shift in (np.uint64(0), np.uint64(2)):
        d = (((packed(fps) >> shift) & low) | np.uint64(0x4444444444444444)) - ((packed(one) >> shift) & low)
        odd = d & field
        total += np.bitwise_count(odd) + 2 * np.bitwise_count((d >> np.uint64(1)) & field & ~odd)
    return total


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges (k, 2) of a spanning forest of the graph that links values within `radius` bits."""
    fps = fps.astype(np.uint64)
    left, edges = np.arange(len(fps)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = bounds_of(fps[left], fps[node]) <= radius
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[node]) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                frontier.extend(hit.tolist())
                edges.append(np.column_stack((np.full(len(hit), node), hit)))
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) longs that span the graph of distinct values `fp` within `radius` differing bits.

    Pairs of small cells are all returned; dense cells return a spanning forest. The transitive
    closure is that of all pairs.
    """
    masks = cell_masks(grid_groups(fps.count(), radius), radius)
    cells = F.array(*[F.struct(F.lit(k).alias("c"), F.col("e").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", embedding(F.col("fp")).alias("e")).select("fp", F.explode(cells).alias("cell")).select("fp", "cell.c", "cell.v")
    shared = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, ["c", "v"]))

    def near(a: Column, b: Column) -> Column:
        return (manhattan(embedding(a), embedding(b)) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)

    small = members.where(F.col("n") <= DENSE).groupBy("c", "v").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pair = F.flatten(
        F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    sparse = small.select(F.explode(pair).alias("p")).select("p.a", "p.b")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    spread = (
        members.where(F.col("n") > DENSE)
        .withColumn("own", own)
        .select("c", "v", "fp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), "own")
        .select("c", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )

    def span(group: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(group["fp"].to_numpy(np.int64))
        found = forest(values, radius)
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    dense = spread.groupBy("c", "v", "i", "j").applyInPandas(span, "a long, b long")
    return sparse.union(dense).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest reachable doc_id."""
    prints = cut(fingerprints(docs, doc_id, text, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labelled = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def similar_texts(texts: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 3) -> DataFrame:
    """(t, root) of texts (t, text) with a word-shingle Jaccard similarity of percent / 100 or more to another one.

    Links of fingerprints within `radius` bits come first and are verified by the sets. Similar texts may
    differ in far more bits than any grid can join, so an exact completion finds all others. root is the
    smallest key of the component.
    """
    made = jaccard.profiles(texts, shingle, percent, majority)
    classes = cut(made.groupBy("fp").agg(F.min("t").alias("rep")))
    a, b = (classes.select(F.col("fp").alias(k), F.col("rep").alias(f"rep_{k}")) for k in "ab")
    near = links(classes.select("fp"), radius).join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    equal = made.select("t", "fp").join(classes, "fp").where("t <> rep").select(F.col("t").alias("a"), F.col("rep").alias("b"))
    found = jaccard.complete(texts, made, near.union(equal), shingle, percent)
    return components(found).select(F.col("node").alias("t"), "root")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
