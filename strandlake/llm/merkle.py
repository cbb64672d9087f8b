"""Merkle manifest of a dataset: a root over all rows, and for every row the proof that it is in it.

A leaf is the digest of a row's columns. Leaves of one source stand in order; every `FAN`
consecutive nodes (the last run may be shorter, even one) become one, until one is left: the
source's subroot. Subroots, by source, become the root in the same way.

Blocks of `BLOCK` nodes are reduced in tasks of their own, in as many distributed rounds as it takes
to leave `TOP` nodes at most. The driver builds the small tree above them and broadcasts each of its
nodes' path to the root; tasks then finish the proofs of their rows and fold each row's digest up to
a root. Sources so many that they alone are over `TOP` are numbered and reduced by rounds as well.
No task holds more than a block, and the driver holds no more than `TOP` nodes.

Defined results: null columns have a digest of their own (`-`), so an empty text and a null one
differ; a null source is the first; rows without an order value come first, and rows of equal order
go by their digest; equal rows have a proof each; an empty table gives an empty result; columns that
are neither digested nor kept are ignored. Texts of any length are digested whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered, numbered_within
from ..session import cut

FAN, HEIGHT = 16, 3
#: Nodes that one task reduces at a time: FAN to the HEIGHT.
BLOCK = FAN**HEIGHT
#: Nodes that the driver's tree has at the bottom, at most.
TOP = 16384
#: Tree of the subroots of all sources, where they are reduced in rounds.
JOINED = "*"

_PROOF = "array<struct<before:string,after:string>>"
_PROOF_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns' values: each `-` if null, else its UTF-8 bytes' count, `:` and the value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def joined(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], rounds: int | None = None) -> list[list[str]]:
    """The nodes, and those of each round above them: `rounds` of them, or until one node is left."""
    made = [nodes]
    while len(made) <= rounds if rounds is not None else len(made[-1]) > 1:
        last = made[-1]
        made.append([joined(last[k : k + FAN]) for k in range(0, len(last), FAN)])
    return made


def path(made: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    """For node `at` of the lowest level: what stands before and after it in its run, level by level."""
    steps = []
    for nodes in made[:-1]:
        low = at // FAN * FAN
        steps.append((nodes[low:at], nodes[at + 1 : low + FAN]))
        at //= FAN
    return steps


def rounds_of(size: int) -> int | None:
    """Rounds within a block of a tree of `size` nodes: all that are left, where the tree is one block."""
    return HEIGHT if size > BLOCK else None


def top_paths(nodes: list[tuple[str, int, str]]) -> tuple[str | None, dict[tuple[str, int], tuple[list, str | None]]]:
    """(root, for each (tree, place) its steps to the root and its source's subroot) of all (tree, place, digest)."""
    trees: dict[str, list[str]] = {}
    for tree, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    made = {tree: levels(own) for tree, own in trees.items()}
    if not trees or JOINED in trees:
        above, root = {JOINED: []}, made[JOINED][-1][0] if trees else None
    else:
        upper = levels([own[-1][0] for own in made.values()])
        above, root = {tree: path(upper, k) for k, tree in enumerate(made)}, upper[-1][0]
    return root, {(tree, k): (path(own, k) + above[tree], None if tree == JOINED else own[-1][0]) for tree, own in made.items() for k in range(len(own[0]))}


def _block_rows(table: pa.Table) -> tuple[pa.Table, list[str], list[list[str]]]:
    """A block's rows in order, their digests, and the levels above them."""
    table = table.sort_by("__p")
    nodes = table.column("__node").to_pylist()
    return table, nodes, levels(nodes, rounds_of(table.column("__size")[0].as_py()))


def _reduced(key: tuple, table: pa.Table) -> pa.Table:
    _, _, made = _block_rows(table)
    size = table.column("__size")[0].as_py()
    blocks = -(-size // BLOCK)
    return pa.table({"__tree": [key[0].as_py()], "__k": pa.array([key[1].as_py()], pa.int64()), "__n": pa.array([blocks], pa.int64()), "__node": [made[-1][0]]})


def reduce_blocks(rows: DataFrame) -> DataFrame:
    """One node (`__tree`, `__k`, of `__n`, `__node`) for each block of rows (`__in`, `__p`, of `__size`, `__node`)."""
    narrow = rows.select("__in", F.expr(f"__p div {BLOCK}").alias("__block"), "__p", "__size", "__node")
    return narrow.groupBy("__in", "__block").applyInArrow(_reduced, "__tree string, __k long, __n long, __node string")


class Manifest:
    """Rows with their places, the root over all of them, and what their proofs need."""

    def __init__(self, rows: DataFrame, keep: list[str], top: int = TOP) -> None:
        """rows: `keep` columns, `__in`, `__p`, `__size`, `__node` and `__probe`, as `manifest` makes them."""
        self.keep, self.levels = keep, [rows]
        while True:
            nodes = cut(reduce_blocks(self.levels[-1]))
            held = nodes.limit(top + 1).collect()
            if len(held) <= top:
                break
            whole = not nodes.where("__n > 1").limit(1).count() and not nodes.where(F.col("__tree") == JOINED).limit(1).count()
            if whole:  # a subroot each: from here on they are one tree
                placed = numbered(nodes, ["__tree"]).withColumn("__p", F.col("place") - 1).withColumn("__size", F.lit(nodes.count()))
                self.levels.append(placed.select("__tree", "__k", F.lit(JOINED).alias("__in"), "__p", "__size", "__node"))
            else:
                self.levels.append(nodes.select("__tree", "__k", F.col("__tree").alias("__in"), F.col("__k").alias("__p"), F.col("__n").alias("__size"), "__node"))
        self.root, self.paths = top_paths([(r["__tree"], r["__k"], r["__node"]) for r in held])

    def _with_paths(self, rows: DataFrame, paths: DataFrame | None) -> DataFrame:
        """Rows and, if paths are rows as well, one row more for each block, which has its path."""
        rows = rows.withColumn("__block", F.expr(f"__p div {BLOCK}")).withColumn("__path", F.lit(None).cast("string"))
        return rows if paths is None else rows.unionByName(paths.withColumnsRenamed({"__tree": "__in", "__k": "__block"}), allowMissingColumns=True)

    def proofs(self) -> DataFrame:
        """Every row's kept columns, leaf, subroot, root, proof (siblings before and after, from the row upwards) and folded_root."""
        shared, root, keep = self.levels[0].sparkSession.sparkContext.broadcast(self.paths), self.root, self.keep

        def block(key: tuple, table: pa.Table) -> tuple[pa.Table, list[str], list[list[str]], list, str | None]:
            given = [p for p in table.column("__path").to_pylist() if p is not None]
            steps, subroot = json.loads(given[0]) if given else shared.value[key[0].as_py(), key[1].as_py()]
            rows, nodes, made = _block_rows(table.filter(pa.compute.is_valid(table.column("__node"))))
            return rows, nodes, made, steps, subroot

        def downwards(key: tuple, table: pa.Table) -> pa.Table:
            rows, nodes, made, steps, subroot = block(key, table)
            own = [json.dumps([path(made, k) + steps, node if key[0].as_py() == JOINED and tree != JOINED else subroot]) for k, (node, tree) in enumerate(zip(nodes, rows.column("__tree").to_pylist(), strict=True))]
            return pa.table({"__tree": rows.column("__tree"), "__k": rows.column("__k"), "__path": own})

        paths = None
        for nodes in reversed(self.levels[1:]):
            paths = cut(self._with_paths(nodes, paths).groupBy("__in", "__block").applyInArrow(downwards, "__tree string, __k long, __path string"))

        def finish(key: tuple, table: pa.Table) -> pa.Table:
            rows, nodes, made, steps, subroot = block(key, table)
            upper = [("".join(a), "".join(z)) for a, z in steps]
            proofs, folded = [], []
            for k, (node, probe) in enumerate(zip(nodes, rows.column("__probe").to_pylist(), strict=True)):
                proof = [("".join(a), "".join(z)) for a, z in path(made, k)] + upper
                found = node if probe is None else probe
                for before, after in proof:
                    found = joined((before, found, after))
                proofs.append([{"before": a, "after": z} for a, z in proof])
                folded.append(found)
            own = {name: rows.column(name) for name in keep}
            same = lambda value: pa.array([value] * len(nodes), pa.string())
            return pa.table(own | {"leaf": rows.column("__node"), "subroot": same(made[-1][0] if subroot is None else subroot), "root": same(root), "proof": pa.array(proofs, _PROOF_TYPE), "folded_root": pa.array(folded, pa.string())})

        rows = self._with_paths(self.levels[0], paths)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
        made = ", ".join([*fields, "leaf string", "subroot string", "root string", f"proof {_PROOF}", "folded_root string"])
        return rows.groupBy("__in", "__block").applyInArrow(finish, made)


def manifest(
    docs: DataFrame,
    columns: list[str],
    source: str = "source",
    order: str = "doc_id",
    probe: Column | None = None,
    keep: list[str] | None = None,
    top: int = TOP,
) -> Manifest:
    """The manifest of `docs`, whose rows' digests are of `columns`.

    `probe`: a digest that is to be folded up in a row's stead, as a later copy of the data would
    give it; null, or none, for the row's own. `keep`: further columns that the proofs carry.
    """
    keep = list(dict.fromkeys([order, *(keep or [])]))
    leaf = digest([F.col(f"`{c}`") for c in columns])
    tree = F.when(F.col(f"`{source}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{source}`")))
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], tree.alias("__in"), leaf.alias("__node"), (F.lit(None).cast("string") if probe is None else probe).alias("__probe"))
    return Manifest(numbered_within(narrow, "__in", [order, "__node"], "__p", "__size"), keep, top)
