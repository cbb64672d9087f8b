"""Sharding by sampled splitters: near equal bytes, equal texts together.

Rows are ordered by a hash of their text, so that equal texts are neighbours. Size-weighted samples
of the keys give quantile splitters of many fine ranges; the ranges' exact sizes are then summed and
laid end to end, and shard boundaries are cut into them. A range that a boundary falls into is
subdivided at the row where it falls, between two groups of equal texts.

A group of equal texts of more than `HEAVY` of a shard is ordered by doc_id too, and gets ranges of
its own. It is dealt out whole, largest first to the emptiest shard; where that would overfill a
shard, the largest groups are subdivided until none is overfull. At most shards / HEAVY groups can
be so large, so what the driver holds of them is bounded, as are the samples and the ranges.

Law: `bytes`. Sizes differ by about the largest light group (HEAVY of a shard) and the largest text.

Defined results: a null text has size 1 and the CRC of the empty text; repeated rows are separate
rows; rows of equal text and id are dealt out in any order; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

HEAVY = 0.02
SAMPLES_PER_RANGE = 16
#: Documents' bytes that a fine range has, about; the number of ranges stays within these bounds.
RANGE_BYTES, FEWEST, MOST = 256 << 10, 512, 65536
LOW = 24


def _key(low: F.Column | None = None):
    high = F.shiftleft(F.shiftrightunsigned("h", LOW), LOW)
    return high if low is None else high.bitwiseOR(low)


def _slots(key: int) -> int:
    """End of the keys that share the high part of `key`."""
    return (key >> LOW << LOW) + (1 << LOW)


def plan(ranges: list[tuple[int, int]], heavy: dict[int, int], shards: int) -> list[list[tuple[int, int]]]:
    """Cuts of each range: (bytes into the range, shard from there on), the first at 0.

    ranges: (high key of its heavy group or None, bytes), in key order.
    """
    total = sum(size for _, size in ranges)
    share = total / shards
    whole = share
    while True:
        load = [0.0] * shards
        pieces: dict[int, list[tuple[float, int]]] = {}
        units = []
        for group, size in heavy.items():
            parts = 1 if size <= whole else math.ceil(size / whole)
            units += [(size / parts, group, p) for p in range(parts)]
        for size, group, _ in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
            shard = min(range(shards), key=lambda s: (load[s], s))
            pieces.setdefault(group, []).append((size, shard))
            load[shard] += size
        if max(load) <= share or whole < share * HEAVY:
            break
        whole /= 2
    edges: dict[int | None, list[tuple[float, int]]] = {}
    for group, own in pieces.items():
        at, cuts = 0.0, []
        for size, shard in sorted(own, key=lambda x: x[1]):
            cuts.append((at, shard))
            at += size
        edges[group] = cuts
    light = total - sum(heavy.values())
    room = [max(share - x, 0.0) for x in load]
    scale = light / sum(room) if sum(room) else 0.0
    at, cuts = 0.0, []
    for shard in range(shards):
        if room[shard] > 0 or shard == 0:
            cuts.append((at, shard))
            at += room[shard] * scale
    edges[None] = cuts
    done: dict[int | None, int] = {}
    out = []
    for group, size in ranges:
        own, begin = edges[group], done.get(group, 0)
        places = [p for p, _ in own]
        k = max(bisect_right(places, begin) - 1, 0)
        cuts = [(0, own[k][1])]
        for place, shard in own[k + 1 :]:
            if place >= begin + size:
                break
            cuts.append((int(place - begin), shard))
        out.append(cuts)
        done[group] = begin + size
    return out


def deal(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    value = F.col(text)
    raw = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(value, F.lit(""))).alias("h"),
    )
    base = cut(raw.withColumn("high", _key()))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    groups = base.groupBy("high").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(HEAVY * total / shards))
    heavy = {r["high"]: r["bytes"] for r in groups.collect()}
    low = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)).bitwiseAND(F.lit((1 << LOW) - 1))
    is_heavy = F.col("high").isin(list(heavy)) if heavy else F.lit(False)
    keyed = base.withColumn("key", F.when(is_heavy, _key(low)).otherwise(F.col("high")))

    wanted = int(min(MOST, max(FEWEST, total // RANGE_BYTES)))
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    sampled = keyed.where(draw < F.col("size") * (wanted * SAMPLES_PER_RANGE / max(total, 1))).select("key", "size")
    drawn = sampled.toArrow()
    keys, sizes = drawn["key"].to_numpy(), np.maximum(drawn["size"].to_numpy(), max(total, 1) / (wanted * SAMPLES_PER_RANGE))
    order = np.argsort(keys, kind="stable")
    steps = np.floor(np.cumsum(sizes[order]) / max(sizes.sum(), 1) * wanted) if len(keys) else np.zeros(0)
    picked = keys[order][np.flatnonzero(np.diff(steps, prepend=0) > 0)] if len(keys) else np.zeros(0, np.int64)
    ends = [g for high in heavy for g in (high, _slots(high)) if g < 1 << 63]
    splitters = np.unique(np.concatenate((picked.astype(np.int64), np.array(ends, np.int64))))
    shared = docs.sparkSession.sparkContext.broadcast(splitters)

    def place(batches):
        for batch in batches:
            k = np.searchsorted(shared.value, batch.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int32())], names=[*batch.schema.names, "range"])

    id_type = base.schema["doc_id"].dataType.simpleString()
    placed = keyed.select("doc_id", "size", "text_crc32", "high", "key").mapInArrow(
        place, f"doc_id {id_type}, size long, text_crc32 long, high long, key long, range int"
    )
    held = {r["range"]: r["b"] for r in placed.groupBy("range").agg(F.sum("size").alias("b")).collect()}
    starts = [None, *splitters.tolist()]
    rows = [(k, starts[k] >> LOW << LOW if starts[k] is not None and (starts[k] >> LOW << LOW) in heavy else None, held[k]) for k in sorted(held)]
    cuts = plan([(group, size) for _, group, size in rows], heavy, shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(k, [p for p, _ in c], [s for _, s in c]) for (k, _, _), c in zip(rows, cuts, strict=True)], "range int, places array<long>, owners array<int>"
    )

    by_range = Window.partitionBy("range").orderBy("key", "doc_id")
    before = placed.withColumn("end", F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of one light group share the place of the first, so that no boundary falls between them
    at = F.min(F.col("end") - F.col("size")).over(Window.partitionBy("range", "key"))
    cutted = before.withColumn("at", at).join(F.broadcast(table), "range")
    owner = F.element_at("owners", F.greatest(F.lit(1), F.size(F.filter("places", lambda p: p <= F.col("at")))))
    sharded = cut(cutted.select("doc_id", "size", "text_crc32", "key", "range", owner.alias("shard")))

    counts = sorted((r["shard"], r["range"], r["n"]) for r in sharded.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    offsets, last, running = [], None, 0
    for shard, part, n in counts:
        running = 0 if shard != last else running
        offsets.append((shard, part, running))
        last, running = shard, running + n
    base_slots = spark.createDataFrame(offsets, "shard int, range int, base long")
    number = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "doc_id")) - 1
    return sharded.withColumn("number", number).join(F.broadcast(base_slots), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).alias("slot")
    )
