"""Grouping reads into molecules, exactly and with tolerance, and what follows for a molecule."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import NO_MATE
from ..session import cut
from .intervals import STRETCH, running

KEY = ["sample", "contig", "left_start", "right_end", "left_bc", "right_bc"]


def exact_groups(reads: DataFrame, forced_by_name: bool = True) -> DataFrame:
    """Reads with molecule_key: a 128-bit hash of their coordinates and barcodes.

    Reads of one name go to one molecule, that of the smallest key among them.
    """
    own = F.md5(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(str(NO_MATE))) for c in KEY]))
    rows = reads.withColumn("molecule_key", own)
    if not forced_by_name:
        return rows
    return rows.withColumn("molecule_key", F.min("molecule_key").over(Window.partitionBy("sample", "qname")))


def molecule_summary(reads: DataFrame, key: list[str]) -> DataFrame:
    """Reads by strand, insert range, clipping and orientation of each molecule."""
    return reads.groupBy(*key).agg(
        F.count("*").alias("n_reads"),
        F.count_if(F.col("strand") == "F").alias("n_top"),
        F.count_if(F.col("strand") != "F").alias("n_bottom"),
        F.min(F.abs("insert_size")).alias("min_insert"),
        F.max(F.abs("insert_size")).alias("max_insert"),
        F.floor(F.sum("n_clipped") / F.count("*")).cast("long").alias("avg_clipped"),
        (F.sum(F.when(F.col("negative"), 1).otherwise(-1)) > 0).alias("top_is_negative"),
        F.max("wrong_pair").alias("has_wrong_pair"),
    )


def barcode_consensus(reads: DataFrame, key: list[str], barcode: str, length: int) -> DataFrame:
    """Most frequent letter but N of each barcode place; N for a tie or without any."""
    def place(k: int) -> Column:
        letter = F.substring(barcode, k, 1)
        counts = F.array(*[F.struct(F.count_if(letter == c).alias("n"), F.lit(c).alias("c")) for c in "ACGT"])
        ordered = F.sort_array(counts, asc=False)
        top, second = ordered[0], ordered[1]
        return F.when((top["n"] == 0) | (top["n"] == second["n"]), "N").otherwise(top["c"])

    return reads.groupBy(*key).agg(F.concat(*[place(k) for k in range(1, length + 1)]).alias("consensus"), F.count("*").alias("n_reads"))


def insert_probability(reads: DataFrame, most: int = 1000) -> DataFrame:
    """Smoothed share of each insert size: exponential smoothing outward from the mode.

    alpha is 0.5 until a smoothed count is below 50, then 0.2. The histogram has `most` bins at most.
    """
    counts = reads.where((F.col("insert_size") > 0) & (F.col("insert_size") < most)).groupBy("insert_size").agg(F.count("*").alias("n"))

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(most)
        values[group["insert_size"].to_numpy(int)] = group["n"].to_numpy(float)
        mode = int(values.argmax())
        out = values.copy()
        for step in (1, -1):
            average = values[mode]
            for k in range(mode + step, most if step > 0 else -1, step):
                alpha = 0.5 if average >= 50 else 0.2
                average = alpha * values[k] + (1 - alpha) * average
                out[k] = average
        return pd.DataFrame({"insert_size": np.arange(most), "p": out / max(out.sum(), 1e-300)})

    return counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda g: smooth(g), "insert_size int, p double")


def covering_clipping(molecules: DataFrame) -> DataFrame:
    """Mean clipping of the molecules over each position, from +1/-1 events and running sums."""
    plus = molecules.select("contig", F.col("start").alias("at"), F.lit(1).alias("d"), F.col("n_clipped").alias("c"))
    events = plus.union(molecules.select("contig", F.col("end") + 1, F.lit(-1), -F.col("n_clipped")))
    steps = events.groupBy("contig", "at").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    made = running(steps, "at", ["d", "c"]).select("contig", F.col("at").alias("start"), (F.col("next_at") - 1).alias("end"), F.col("run_d").alias("n"), F.col("run_c").alias("total"))
    return made.where("n > 0 AND end IS NOT NULL").withColumn("mean_clipping", F.round(F.col("total") / F.col("n"), 6)).drop("total")


def merged_barcode_mismatches(molecules: DataFrame, merged: DataFrame, length: int) -> DataFrame:
    """Counts of letters that differ between merged molecules' left barcodes and their targets', by place.

    Targets' barcodes are looked up in `molecules`, unless `merged` has them, as `target_bc`.
    """
    # said of the name, Spark sees that rows without a place, which go nowhere, need not be read
    pairs = merged.where("molecule IS NOT NULL AND molecule <> merged_into")
    if "target_bc" not in merged.columns:
        into = molecules.select(F.col("molecule").alias("merged_into"), F.col("left_bc").alias("target_bc"))
        pairs = pairs.join(into, "merged_into")
    places = F.explode(F.sequence(F.lit(1), F.lit(length))).alias("place")
    letters = pairs.select(places, "left_bc", "target_bc").select(
        "place", F.substr("target_bc", F.col("place"), F.lit(1)).alias("fst"), F.substr("left_bc", F.col("place"), F.lit(1)).alias("snd")
    )
    return letters.where("fst <> snd").groupBy("place", "fst", "snd").agg(F.count("*").alias("n"))


#: Width of a bin of molecules' starts, in tolerances; rows that are compared in one go, about, and pairs of them at once.
BINS_WIDE = 60
ROWS, PAIRS = 50_000, 2_000_000
ORDER = ["left_start", "right_end", "left_bc", "right_bc"]


def _by_bins(rows: DataFrame, tolerance: int, keys: list[str], made: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], ddl: str, then: dict[str, Column] | None = None) -> DataFrame:
    """What `made` gives of rows and the number of each one's bin, some whole bins at a time.

    Rows are dealt out by `keys` and a bin of their starts, once; those within `tolerance` of a bin's end also go to
    the next one, as `guest`. `open` marks rows that two bins have. A task holds the rows of `ROWS` or of one bin.
    `then`: columns that follow from a row, made where it was dealt to.
    """
    width = BINS_WIDE * tolerance or BINS_WIDE
    own, last = F.floor(F.col("left_start") / width), F.floor((F.col("left_start") + tolerance) / width)
    placed = rows.where("left_start IS NOT NULL AND right_end IS NOT NULL").select("*", (own != last).alias("open"), F.explode(F.sequence(own, last)).alias("bin"))
    dealt = placed.withColumn("guest", F.col("bin") != own).repartition(*keys, "bin").sortWithinPartitions(*keys, "bin")

    return dealt.withColumns(then or {}).mapInArrow(_by_runs([*keys, "bin"], ROWS, made), ddl)


def _by_runs(columns: list[str], rows: int, made: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches sorted by `columns`: what `made` gives of about `rows`, and of whole runs of equal `columns`, with each row's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, enough = 0, rows
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= enough:
                table = pa.concat_tables(held).combine_chunks()
                number = _runs_of(table, columns)
                whole = int(np.searchsorted(number, number[-1]))
                held, size = [table.slice(whole)], len(number) - whole
                # a long run is not looked through again for each batch
                enough = max(rows, 2 * size)
                if whole:
                    for part in made(table.slice(0, whole), number[:whole]):
                        yield from part.to_batches()
        if size:
            table = pa.concat_tables(held).combine_chunks()
            for part in made(table, _runs_of(table, columns)):
                yield from part.to_batches()

    return run


def _runs_of(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Number of the run of rows that are equal in all of `columns`."""
    new = np.zeros(table.num_rows, bool)
    for c in columns:
        code = pd.factorize(table[c].to_pandas(), use_na_sentinel=False)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _letters(column: pa.ChunkedArray) -> np.ndarray:
    """The letters of each barcode as numbers, 0 behind its end."""
    text = np.array([x or "" for x in column.to_pylist()], "U")
    return np.ascontiguousarray(text).view(np.uint32).reshape(len(text), -1)


def _expanded(rows: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number) for each row and each number from its `begin` to before its `stop`, about `PAIRS` at once."""
    size = np.maximum(stop - begin, 0)
    rows, begin, size = rows[size > 0], begin[size > 0], size[size > 0]
    before = np.concatenate(([0], np.cumsum(size)))
    a = 0
    while a < len(rows):
        z = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, side="right")) - 1)
        n = size[a:z]
        step = np.arange(int(n.sum())) - np.repeat(before[a:z] - before[a], n)
        yield np.repeat(rows[a:z], n), np.repeat(begin[a:z], n) + step
        a = z


def _compatible(table: pa.Table, bins: np.ndarray, tolerance: int, mismatches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of compatible pairs, each once, of rows in one bin; not of two guests.

    Barcodes of the common length and without N meet by bands: with m letters allowed in each, one of 2 m + 1 bands
    of both together is equal, and a pair is given where its first such band is. Others, few, meet all rows of their places.
    """
    start, end = (table[c].to_numpy().astype(np.int64) for c in ("left_start", "right_end"))
    guest = table["guest"].to_numpy()
    left, right = _letters(table["left_bc"]), _letters(table["right_bc"])
    both, n = np.hstack((left, right)), ord("N")
    bands = 2 * mismatches + 1
    edges = [round(both.shape[1] * k / bands) for k in range(bands + 1)]
    loose = ((both == n) | (both == 0)).any(axis=1) | (bands > both.shape[1])
    codes = []
    for a, z in zip(edges, edges[1:], strict=False):
        code = np.zeros(len(both), np.int64)
        for k in range(a, z):
            code = code * 1_000_003 + both[:, k]
        codes.append(code)
    # a bin's starts lie closer together than this
    base = start - start.min()
    span = int(base.max()) + tolerance + 1

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (np.abs(end[i] - end[j]) <= tolerance) & ~(guest[i] & guest[j])
        i, j = i[near], j[near]
        for part in (left, right):
            differ = np.zeros(len(i), np.int64)
            for k in range(part.shape[1]):
                x, y = part[i, k], part[j, k]
                differ += (x != y) & (x != n) & (y != n) & (x != 0) & (y != 0)
            i, j = i[differ <= mismatches], j[differ <= mismatches]
        return i, j

    strict = np.flatnonzero(~loose)
    for k, code in enumerate(codes):
        order = strict[np.lexsort((base[strict], code[strict], bins[strict]))]
        group = np.cumsum(np.concatenate((order[:0], [0][: len(order)], (bins[order][1:] != bins[order][:-1]) | (code[order][1:] != code[order][:-1]))))
        at = group * span + base[order]
        for i, j in _expanded(order, np.arange(len(order)) + 1, np.searchsorted(at, at + tolerance, side="right")):
            j = order[j]
            first = np.ones(len(i), bool)
            for earlier in codes[:k]:
                first &= earlier[i] != earlier[j]
            yield fit(i[first], j[first])
    open_ = np.flatnonzero(loose)
    if len(open_):
        order = np.lexsort((base, bins))
        at, own = bins[order] * span + base[order], bins[open_] * span + base[open_]
        low = np.maximum(own - tolerance, bins[open_] * span)
        for i, j in _expanded(open_, np.searchsorted(at, low), np.searchsorted(at, own + tolerance, side="right")):
            j = order[j]
            once = ~loose[j] | (i < j)
            yield fit(i[once], j[once])


def compatible_molecules(rows: DataFrame, tolerance: int, barcode_mismatches: int, keys: list[str], name: str = "molecule") -> DataFrame:
    """(a, b), each pair once: rows of equal `keys` with both ends within `tolerance` and both barcodes within `barcode_mismatches` letters.

    Letters are compared up to the end of the shorter barcode, and N fits anything. Each row is shuffled once, but
    for the few near the end of a bin of starts; pairs are made within tasks.
    """
    kind = rows.schema[name].dataType.simpleString()
    held = rows.select(*keys, F.col(name).alias("id"), *ORDER)

    def made(table: pa.Table, bins: np.ndarray) -> Iterator[pa.Table]:
        for i, j in _compatible(table, bins, tolerance, barcode_mismatches):
            yield pa.table({"x": table["id"].take(pa.array(i)), "y": table["id"].take(pa.array(j))})

    found = _by_bins(held, tolerance, keys, made, f"x {kind}, y {kind}")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def leaders(links: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node) of those that stay, of cut links (v, u) from each node to the earlier ones that it may join.

    In turn, a node joins an earlier one that stays, or stays itself. Rounds decide all nodes whose
    earlier ones are decided: as many as the longest chain of decisions that wait for each other.
    """
    # semi and anti joins only: what Spark guesses of their sizes doesn't multiply from round to round
    waiting = links.select("v", "u")
    stays = cut(links.select(F.col("u").alias("node")).distinct().join(waiting.select(F.col("v").alias("node")), "node", "left_anti"))
    staying = [stays]
    for _ in range(max_rounds):
        as_u = lambda nodes: nodes.select(F.col("node").alias("u"))
        merged = cut(waiting.join(as_u(stays), "u", "left_semi").select(F.col("v").alias("node")).distinct())
        held = waiting.join(merged.select(F.col("node").alias("v")), "v", "left_anti")
        rest = cut(held.join(as_u(merged), "u", "left_anti"))
        # all that they waited for was merged
        stays = cut(held.select(F.col("v").alias("node")).distinct().join(rest.select(F.col("v").alias("node")), "node", "left_anti"))
        waiting = rest
        staying.append(stays)
        if not waiting.limit(1).count():
            break
    else:
        raise RuntimeError("merging did not settle")
    return reduce(DataFrame.union, staying)


def fuzzy_merge(molecules: DataFrame, tolerance: int, barcode_mismatches: int, chunk: list[str], max_rounds: int = 10_000, named_once: bool = False) -> DataFrame:
    """Molecules with merged_into: each in turn goes to the first one before it that stays and is compatible, or stays itself.

    Order: most reads, then larger minimum over strands, positions, barcodes and the molecule's name. Two
    molecules are compatible if they have equal `chunk` columns, both ends lie within `tolerance` and both
    barcodes differ in `barcode_mismatches` letters at most, N fitting anything.

    Done where molecules meet: one with a link to an earlier molecule that stays is merged, one whose earlier links
    are all merged stays. What hangs on molecules near the end of a bin, which two tasks have, is decided after that
    in rounds over the links left. The result is that of going through all molecules in turn; no island of linked
    molecules is held by one task. Rounds are as many as the longest chain of decisions that wait for each other
    over such ends, and each is checkpointed. With a tolerance of 0 no bins touch, and there are none.

    `named_once`: no two rows have one name. With a tolerance of 0 rows then come whole from where they meet, without
    a join by name, and with `target_bc`, the left barcode of the molecule that they go to. All their columns are dealt out.
    """
    rank = ["reads", "least", *ORDER, "molecule"]
    lowest = F.lit(-(1 << 63))
    reads, least = -(F.col("n_top") + F.col("n_bottom")), -F.least("n_top", "n_bottom")
    counts = {"reads": F.coalesce(reads.cast("long"), lowest), "least": F.coalesce(least.cast("long"), lowest)}
    if named_once and tolerance == 0:
        return _merged_in_place(molecules, barcode_mismatches, chunk, rank, counts)
    rows = molecules.select(*chunk, "molecule", *ORDER, *[c.alias(name) for name, c in counts.items()])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def made(table: pa.Table, bins: np.ndarray) -> Iterator[pa.Table]:
        none = np.zeros(0, np.int64)
        i, j = (np.concatenate(c) for c in zip((none, none), *_compatible(table, bins, tolerance, barcode_mismatches), strict=True))
        v, u, known, final = _decided(table, i, j, rank)
        found = {"v": table["molecule"].take(pa.array(v)), "u": table["molecule"].take(pa.array(u)), "known": pa.array(known), "final": pa.array(final)}
        yield pa.table(found | {c: table[c].take(pa.array(u, mask=final)) for c in rank})

    links = _by_bins(rows, tolerance, chunk, made, f"v {kind['molecule']}, u {kind['molecule']}, known boolean, final boolean, " + ", ".join(f"{c} {kind[c]}" for c in rank))
    if tolerance == 0:
        targets = links.select(F.col("v").alias("molecule"), F.col("u").alias("merged_into"))
    else:
        links = cut(links.select("v", "u", "known", "final", F.when(~F.col("final"), F.struct(*rank)).alias("rank")))
        later = links.where("NOT final").drop("final")
        if later.where("NOT known").limit(1).count():
            kept = leaders(later, max_rounds)
            later = later.join(kept, later["u"] == kept["node"])
        merged = later.groupBy("v").agg(F.min_by("u", "rank").alias("u"))
        targets = links.where("final").select("v", "u").union(merged).toDF("molecule", "merged_into")
    return molecules.join(targets, "molecule", "left").withColumn("merged_into", F.coalesce("merged_into", "molecule"))


def _merged_in_place(molecules: DataFrame, barcode_mismatches: int, chunk: list[str], rank: list[str], counts: dict[str, Column]) -> DataFrame:
    """`fuzzy_merge` of molecules named once, at a tolerance of 0: each bin has all that its molecules may go to."""
    columns = molecules.columns
    kind = {f.name: f.dataType.simpleString() for f in molecules.schema.fields}

    def made(table: pa.Table, bins: np.ndarray) -> Iterator[pa.Table]:
        none = np.zeros(0, np.int64)
        i, j = (np.concatenate(c) for c in zip((none, none), *_compatible(table, bins, 0, barcode_mismatches), strict=True))
        v, u, _, _ = _decided(table, i, j, rank)
        target = np.arange(table.num_rows)
        target[v] = u
        into = pa.array(target)
        yield table.select(columns).append_column("merged_into", table["molecule"].take(into)).append_column("target_bc", table["left_bc"].take(into))

    ddl = ", ".join([*(f"`{c}` {kind[c]}" for c in columns), f"merged_into {kind['molecule']}, target_bc {kind['left_bc']}"])
    # a molecule without a name goes nowhere, and none goes to it
    own = F.when(F.col("molecule").isNotNull(), F.coalesce("merged_into", "molecule"))
    met = _by_bins(molecules, 0, chunk, made, ddl, counts).withColumn("merged_into", own)
    alone = molecules.where("left_start IS NULL OR right_end IS NULL").select("*", F.col("molecule").alias("merged_into"), F.col("left_bc").alias("target_bc"))
    return met.union(alone)


def _decided(table: pa.Table, i: np.ndarray, j: np.ndarray, rank: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, u, known, final): links of those that are merged or wait to earlier rows, as far as a merge may be by them.

    known: the earlier row stays; else it waits. final: this is where the row is merged.
    """
    n = table.num_rows
    columns = [pd.factorize(table[c].to_pandas(), sort=True)[0] for c in reversed(rank)]
    place = np.empty(n, np.int64)
    place[np.lexsort(columns)] = np.arange(n)
    far = (table["open"].to_numpy() | table["guest"].to_numpy()).astype(bool)
    v, u = np.where(place[i] < place[j], j, i), np.where(place[i] < place[j], i, j)
    merged, stays = np.zeros(n, bool), np.zeros(n, bool)
    a, b = v, u
    while True:
        waits = np.zeros(n, bool)
        waits[a] = True
        # those without an earlier link left
        fresh = ~far & ~waits & ~merged & ~stays
        stays |= fresh
        now = np.zeros(n, bool)
        now[a[stays[b]]] = True
        now &= ~merged
        if not fresh.any() and not now.any():
            break
        merged |= now
        left = ~merged[a] & ~merged[b]
        a, b = a[left], b[left]
    best = np.full(n, n)
    sure = stays[u]
    np.minimum.at(best, v[sure], place[u[sure]])
    use = np.flatnonzero(~stays[v] & ~merged[u] & (place[u] <= best[v]))
    v, u, known = v[use], u[use], sure[use]
    unsure = far.copy()
    unsure[v[~known]] = True
    return v, u, known, ~unsure[v]


def start_islands(molecules: DataFrame, gap: int, stretch: int = STRETCH) -> DataFrame:
    """Molecules with `island` (from 1 in each sample and contig): runs of starts that follow each other within `gap`.

    Starts are counted within stretches of places; what lies before comes from the stretches' own ends and
    counts, so that no task holds a contig.
    """
    where = ["sample", "contig"]
    starts = molecules.select(*where, "left_start").distinct().withColumn("__part", F.floor(F.col("left_start") / stretch))
    own = Window.partitionBy(*where, "__part").orderBy("left_start")
    far = F.coalesce((F.col("left_start") - F.lag("left_start").over(own) > gap).cast("long"), F.lit(0).cast("long"))
    local = starts.withColumn("__new", far).withColumn("__own", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy(*where, "__part").agg(F.min("left_start").alias("__least"), F.max("left_start").alias("__most"), F.sum("__new").alias("__inner"))
    along = Window.partitionBy(*where).orderBy("__part")
    begins = F.coalesce((F.col("__least") - F.lag("__most").over(along) > gap).cast("long"), F.lit(1).cast("long"))
    before = F.coalesce(F.sum(F.col("__inner")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.withColumn("__begins", begins).withColumn("__before", before + F.sum("__begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = local.join(parts.select(*where, "__part", "__before"), [*where, "__part"]).select(*where, "left_start", (F.col("__before") + F.col("__own")).alias("island"))
    return molecules.join(numbered, [*where, "left_start"])


def neighbours(molecules: DataFrame, distance: int = 5, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Pairs of molecules of equal keys within `distance` at both ends that differ at both, by bins of starts."""
    width = distance + 1
    left = molecules.select(*keys, F.col("molecule").alias("a"), F.col("left_start").alias("a_start"), F.col("right_end").alias("a_end"), F.explode(F.array(*[F.floor(F.col("left_start") / width) + k for k in (-1, 0, 1)])).alias("bin"))
    right = molecules.select(*keys, F.col("molecule").alias("b"), F.col("left_start").alias("b_start"), F.col("right_end").alias("b_end"), F.floor(F.col("left_start") / width).alias("bin"))
    near = (F.abs(F.col("a_start") - F.col("b_start")) <= distance) & (F.abs(F.col("a_end") - F.col("b_end")) <= distance)
    both = (F.col("a_start") != F.col("b_start")) & (F.col("a_end") != F.col("b_end"))
    return left.join(right, [*keys, "bin"]).where((F.col("a") < F.col("b")) & near & both).select("a", "b")


#: Spots that go to Python in one go, about.
SPOTS = 50_000


def _chains(spots: pd.DataFrame, group: list[str], distance: float) -> np.ndarray:
    """A number for each of the distinct spots `x`, `y`, equal for those of one chain of steps below `distance` in their group.

    All groups at once: spots of one cell, whose diagonal is below `distance`, are one from the start; others
    are compared with those of the cells around. The least number then sinks along the links.
    """
    x, y = spots["x"].to_numpy(float), spots["y"].to_numpy(float)
    side = distance / np.sqrt(2) * (1 - 1e-9)
    grid = pd.DataFrame({"g": spots.groupby(group, dropna=False, sort=False).ngroup().to_numpy(), "i": np.floor(x / side).astype(np.int64), "j": np.floor(y / side).astype(np.int64)})
    cell = grid.groupby(["g", "i", "j"]).ngroup().to_numpy()
    cells = grid.assign(cell=cell).drop_duplicates("cell")
    rows, count = np.argsort(cell, kind="stable"), np.bincount(cell)
    begin = np.cumsum(count) - count
    met = [cells.assign(i=cells["i"] + di, j=cells["j"] + dj).merge(cells, on=["g", "i", "j"])[["cell_x", "cell_y"]] for di in range(3) for dj in range(-2, 3) if (di, dj) > (0, 0)]
    ends = pd.concat(met).to_numpy()
    sizes = count[ends[:, 0]] * count[ends[:, 1]]
    links = [ends[:0]]
    for _, at in pd.Series(np.arange(len(ends))).groupby(np.cumsum(sizes) // PAIRS):
        one, size = ends[at], sizes[at]
        pair = np.repeat(np.arange(len(one)), size)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        n = count[one[pair, 1]]
        a, b = rows[begin[one[pair, 0]] + step // n], rows[begin[one[pair, 1]] + step % n]
        links.append(one[np.unique(pair[np.hypot(x[a] - x[b], y[a] - y[b]) < distance])])
    a, b = np.concatenate(links).T
    label = np.arange(len(count))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for k in (a, b):
            np.minimum.at(new, label[k], low)
            np.minimum.at(new, k, low)
        label = new[new]
    return label[cell]


def optical_duplicates(reads: DataFrame, distance: int, key: list[str]) -> DataFrame:
    """Reads with optical_duplicate: all but the best of a chain of close spots on a tile.

    Reads are dealt out by molecule and tile, once. An aggregate keeps the best of the reads at one spot, and spots
    go to Python about `SPOTS` at a time, of many molecules, or all of one molecule on one tile. What comes back is
    the best read of each chain; all others with a place are duplicates.
    """
    if distance <= 0:
        return reads.withColumn("optical_duplicate", F.lit(False))
    where = [*key, "run_tile"]
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    # the larger phred, and of equal ones the smaller id
    best = F.max(F.struct("avg_phred", F.bitwise_not("read_id").alias("id"))).alias("best")
    spots = reads.where(placed).select(*where, "read_id", "x", "y", "avg_phred").repartition(*where).groupBy(*where, "x", "y").agg(best)
    sorted_ = spots.select(*where, "x", "y", F.col("best.avg_phred").alias("avg_phred"), F.bitwise_not("best.id").alias("read_id")).sortWithinPartitions(*where)

    def made(table: pa.Table, runs: np.ndarray) -> Iterator[pa.Table]:
        rows = table.select(["x", "y", "avg_phred", "read_id"]).to_pandas().assign(__run=runs)
        several = np.bincount(runs)[runs] > 1
        alone, rows = rows.loc[~several, "read_id"], rows[several].reset_index(drop=True)
        if len(rows):
            ranked = rows.assign(__chain=_chains(rows, ["__run"], distance)).sort_values(["__chain", "avg_phred", "read_id"], ascending=[True, False, True])
            alone = pd.concat([alone, ranked.drop_duplicates("__chain")["read_id"]])
        yield pa.table({"read_id": pa.array(alone.to_numpy(), pa.int64())})

    stays = sorted_.mapInArrow(_by_runs(where, SPOTS, made), "read_id long").withColumn("__stays", F.lit(True))
    return reads.withColumn("__placed", placed).join(stays, "read_id", "left").withColumn("optical_duplicate", F.col("__placed") & F.col("__stays").isNull()).drop("__placed", "__stays")
