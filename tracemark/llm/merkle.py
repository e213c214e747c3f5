"""Merkle dataset manifest: one tree per key over its rows, a tree over their roots, and proofs of many leaves at once.

Every row is a leaf. The leaves of a key (its language) ascend by id; eight consecutive nodes become one of the level above until a single one remains, and the keys'
roots in key order become the leaves of the upper tree. Positions come from ranges of the rows and counts per range, and levels from aligned blocks of `PART_LEAVES` nodes,
so a key with a third of all rows is the work of as many tasks as it has blocks.

Proofs are made an octopus at a time. The leaves to prove are dealt into parts, runs of positions of one tree. A part works out which coordinates (tree, level, index) it
can't derive from its own leaves, the smallest set that proves all of them together; the union over the parts is looked up once; then each part derives the
interiors that its leaves share and writes each leaf's own proof, from its run of siblings to the root. A proof is a list of steps (`before`, `after`), the joined digests left and
right of the node on the way up, so anyone can fold a leaf to the root with `folded`, without this module's tables.

Edge cases: a null in any field is `-`; an empty text is `0:`. Null keys come first, then keys in bytewise order. Null ids come first in their tree, rows with equal ids in the
order of their leaves, so repeated rows are leaves of their own. Other columns are ignored. An empty table has no trees, no root and no proofs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracemark.operators.ranking import positions
from tracemark.session import bounded_broadcast, materialise

ARITY = 8
#: Nodes that one block builds levels from, and leaves that one part proves: a power of the arity, so blocks need no neighbours.
PART_LEVELS = 4
PART_LEAVES = ARITY**PART_LEVELS
UPPER = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, idx long, size long, hash string"
COORDINATES = ["of_tree", "level", "idx"]
PROOF = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Forest:
    """`leaves`: tree, pos, size (leaves of the tree), leaf and carried columns. `nodes`: tree, level, idx, size (of the level), hash. `trees`: tree, key, size, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: each field with its length in bytes before it."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, key: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, **carried: Column) -> DataFrame:
    """`doc_id`, `key`, `leaf` and the carried columns of every row."""
    return docs.select(F.col(order).cast("long").alias("doc_id"), F.col(key).cast("string").alias("key"), leaf_of(*(F.col(f) for f in fields)).alias("leaf"),
                       *(c.alias(name) for name, c in carried.items()))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _placed(rows: DataFrame) -> DataFrame:
    """Adds `tree`, `pos` and `size`: the rank of the key, that of the row in it, and its number of rows."""
    carried = rows.columns
    marked = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))
    order = [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "leaves-ranged")
    counts = materialise(ranged.groupBy("_key", "_slice").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "leaf-counts")
    per_key = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_n").over(per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_key", "_slice", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(per_key).alias("size"))
    ranks = positions(counts.select("_key", F.lit(0).alias("_all")).distinct(), ["_all"], ["_key"]).select("_key", (F.col("position") - 1).cast("long").alias("tree"))
    offsets = materialise(offsets.join(ranks, "_key"), "leaf-offsets")
    joined = ranged.join(bounded_broadcast(offsets), ["_key", "_slice"])
    return joined.select("tree", (F.col("_at") + F.col("_shift")).alias("pos"), "size", *carried)


def _levels(base: DataFrame) -> DataFrame:
    """The next `PART_LEVELS` levels above nodes of one level (tree, level, idx, size, hash), as far as their trees reach."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        tree, level, size = (block.column(c)[0].as_py() for c in ("tree", "level", "size"))
        start, hashes, out = block.column("idx")[0].as_py(), block.column("hash").to_pylist(), []
        for _ in range(PART_LEVELS):
            if size <= 1:
                break
            hashes = [_digest("".join(hashes[i : i + ARITY])) for i in range(0, len(hashes), ARITY)]
            start, size, level = start // ARITY, -(-size // ARITY), level + 1
            out += [(tree, level, start + i, size, h) for i, h in enumerate(hashes)]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["tree", "level", "idx", "size", "hash"])

    blocks = base.where("size > 1").select("tree", "level", "idx", "size", "hash", F.floor(F.col("idx") / PART_LEAVES).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(run, NODES)


def _grown(base: DataFrame, largest: int) -> DataFrame | None:
    """All nodes above `base`, the leaves of trees of at most `largest` leaves; none if no tree has more than one."""
    grown, level = None, 0
    while largest > 1:
        above = materialise(_levels(base), "nodes")
        grown = above if grown is None else grown.unionByName(above)
        largest, level = -(-largest // PART_LEAVES), level + PART_LEVELS
        base = above.where(F.col("level") == level)
    return grown


def forest(rows: DataFrame) -> Forest:
    """Trees over `rows` (`doc_id`, `key`, `leaf` and columns to carry), stored in the shared folder."""
    placed = materialise(_placed(rows), "leaves")
    base = placed.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "size", F.col("leaf").alias("hash"))
    largest = placed.agg(F.max("size")).first()[0] or 0
    nodes = _grown(base, largest)
    tops = base.where("size = 1") if nodes is None else base.where("size = 1").unionByName(nodes.where("size = 1"))
    sizes = placed.where("pos = 0").select("tree", "key", "size")
    trees = materialise(sizes.join(tops.select("tree", F.col("hash").alias("subroot")), "tree"), "trees")
    n_trees = trees.count()
    upper = trees.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("size"), F.col("subroot").alias("hash"))
    above = _grown(upper, n_trees)
    top = upper if above is None else above
    root = top.where("size = 1").first()
    everything = [x for x in (nodes, upper, above) if x is not None]
    full = everything[0]
    for more in everything[1:]:
        full = full.unionByName(more)
    return Forest(placed, full, trees, n_trees, root["hash"] if root else None)


def missing(known: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """Per level the indexes that must be given to reach the root of a tree of `size` leaves from these leaves."""
    known, level, out = np.unique(known), 0, []
    while size > 1:
        runs = np.unique(known // ARITY)
        children = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < size], known, assume_unique=True)))
        known, size, level = runs, -(-size // ARITY), level + 1
    return out


def _climb(known: np.ndarray, hashes: list[str], size: int, given: dict[tuple[int, int], str]) -> tuple[list[tuple[np.ndarray, list[str], list[str]]], str]:
    """Per level the known indexes with the digests left and right of each inside its run, and the root."""
    out, level = [], 0
    while size > 1:
        own, runs, up = dict(zip(known.tolist(), hashes)), np.unique(known // ARITY), []
        before, after = [], []
        for run in runs.tolist():
            at = range(run * ARITY, min((run + 1) * ARITY, size))
            children = [own[i] if i in own else given[level, i] for i in at]
            for place, i in enumerate(at):
                if i in own:
                    before.append("".join(children[:place]))
                    after.append("".join(children[place + 1 :]))
            up.append(_digest("".join(children)))
        out.append((known, before, after))
        known, hashes, size, level = runs, up, -(-size // ARITY), level + 1
    return out, hashes[0]


def proofs(trees: Forest, wanted: DataFrame | None = None) -> DataFrame:
    """Adds `proof` to the wanted rows of `trees.leaves` (all, if none are named)."""
    wanted = trees.leaves if wanted is None else wanted
    n_trees, carried = trees.n_trees, wanted.columns
    wanted = wanted.withColumn("part", F.floor(F.col("pos") / PART_LEAVES))

    def ask(part: pa.Table) -> pa.Table:
        tree, number, size = (part.column(c)[0].as_py() for c in ("tree", "part", "size"))
        rows = [(tree, level, i) for level, found in missing(part.column("pos").to_numpy(), size) for i in found.tolist()]
        rows += [(UPPER, level, i) for level, found in missing(np.array([tree]), n_trees) for i in found.tolist()]
        of_tree, level, idx = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array([tree] * len(rows), pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array(of_tree, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())],
                        ["tree", "part", *COORDINATES])

    def expand(part: pa.Table, given: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table([pa.array([], f.type) for f in part.schema if f.name != "part"] + [pa.array([], kind)], names=[*carried, "proof"])
        part = part.sort_by("pos")
        tree, size, pos = part.column("tree")[0].as_py(), part.column("size")[0].as_py(), part.column("pos").to_numpy()
        own, upper = {}, {}
        for of_tree, level, idx, digest in zip(*(given.column(c).to_pylist() for c in (*COORDINATES, "hash"))):
            (upper if of_tree == UPPER else own)[level, idx] = digest
        unique, at = np.unique(pos, return_index=True)
        inside, subroot = _climb(unique, part.column("leaf").take(pa.array(at)).to_pylist(), size, own)
        outside, _ = _climb(np.array([tree]), [subroot], n_trees, upper)
        before, after, steps, start = [], [], [], 0
        for level, (known, left, right) in enumerate(inside):
            steps.append(start + np.searchsorted(known, pos // ARITY**level))
            before, after, start = before + left, after + right, start + len(known)
        for _, left, right in outside:
            steps.append(np.full(len(pos), start))
            before, after, start = before + left, after + right, start + 1
        pool = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        picked = pool.take(pa.array(np.stack(steps, axis=1).ravel() if steps else np.zeros(0, np.int64)))
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * len(steps), pa.int32()), picked)
        return part.drop_columns(["part"]).append_column("proof", proof)

    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    asked = materialise(wanted.select("tree", "part", "pos", "size").groupBy("tree", "part").applyInArrow(ask, "tree long, part long, of_tree long, level int, idx long"), "missing-nodes")
    known = trees.nodes.select(F.col("tree").alias("of_tree"), "level", "idx", "hash").unionByName(
        trees.leaves.select(F.col("tree").alias("of_tree"), F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")))
    needed = materialise(asked.select(*COORDINATES).distinct(), "needed-nodes")
    fetched = materialise(known.join(bounded_broadcast(needed), COORDINATES, "left_semi"), "fetched-nodes")
    given = asked.join(bounded_broadcast(fetched), COORDINATES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "part") + f", proof {PROOF}"
    return wanted.groupBy("tree", "part").cogroup(given.groupBy("tree", "part")).applyInArrow(expand, schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, joined from the leaf's run to the root's."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")
