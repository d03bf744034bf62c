"""Merkle manifest of a dataset: a tree of digests per part, its blocks stored in van Emde Boas order, and proofs for every row.

Rows of one part (say, a language) are leaves in the order of their key. Up to ``FANOUT`` consecutive nodes become their
parent until one is left, the root of the part; the roots of the parts, ordered by part, are the leaves of one more tree.

The tree is cut into aligned subtrees of ``HEIGHT`` levels above their leaves. Such a block is one row of the manifest, its
nodes one binary value: a subtree is split at half its height, the upper half is stored first and then each lower subtree,
all by the same rule. Where a node lies follows from its depth and number alone (``place``), so that construction and the
retrieval of siblings need no pointers, and a path touches few stretches of a block whatever the size of a cache line. The roots of
the blocks are the leaves of the next pass; the number of passes is the logarithm of the rows.

What a task holds is one block at a time. The number of a leaf comes from a range partitioning and a count per partition and part,
so a part with a third of all rows is spread like any other. Proofs go down the same way: the proof of a block's
root joins the block, and each leaf gets its siblings within the block followed by that.

Edge cases: null is a part of its own and comes first, null keys come first; rows that agree in part and key are ordered by
digest and then are equal; a part of one row has the leaf as root; no rows give no rows; further columns pass through, one named
like an added one is replaced.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.arrow import small_batches
from tallyloom.llm.common import broadcast_below
from tallyloom.plans.small import materialize

FANOUT = 8
HEIGHT = 3  # levels above the leaves of a block: 512 leaves, 585 nodes of 32 bytes
BYTES = 32
ADDED = ("subroot", "root", "proof")
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PROOF = "array<struct<left:string,right:string>>"


def leaf_digest(*columns: Column) -> Column:
    """Hex SHA-256 of the values, each as its number of UTF-8 bytes, a colon and the value, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in texts]), 256)


# ------------------------------------------------------------------------ one block

def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def place(levels: int, depth: int, number):
    """Where the node ``number`` (an integer or an array) of a depth lies in a complete tree of so many levels."""
    at = number * 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        lower = levels - upper
        subtree, number = number // FANOUT ** depth, number % FANOUT ** depth
        at = at + nodes_of(upper) + subtree * nodes_of(lower)
        levels = lower
    return at


@lru_cache(maxsize=16)
def _places(levels: int) -> list[np.ndarray]:
    """The places of all nodes by depth."""
    return [place(levels, depth, np.arange(FANOUT ** depth)) for depth in range(levels)]


def block_levels(leaves: int, whole: bool, height: int = HEIGHT) -> int:
    """Levels of a block: all of them if further blocks stand beside it, else until one node is left."""
    if not whole:
        return height + 1
    levels = 1
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """The digests of a block in van Emde Boas order; nodes that a short last run does not have are zeros."""
    stored = np.zeros((nodes_of(levels), BYTES), np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        stored[_places(levels)[depth][:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, BYTES)
        if depth:
            hexes = b"".join(row).hex().encode()
            width = 2 * BYTES * FANOUT
            row = [hashlib.sha256(hexes[k:k + width]).digest() for k in range(0, len(hexes), width)]
    return stored.tobytes()


def block_paths(nodes: bytes, leaves: int, levels: int) -> tuple[list[str], list[str], np.ndarray]:
    """Hex digests to the left and to the right of every node below the root, deepest level first, and for every leaf which
    of them are on its way up."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, BYTES)
    left, right, steps, count = [], [], [], leaves
    for depth in range(levels - 1, 0, -1):
        hexes = stored[_places(levels)[depth][:count]].tobytes().hex()
        steps.append(len(left) + np.arange(leaves) // FANOUT ** (levels - 1 - depth))
        for k in range(count):
            first = k - k % FANOUT
            left.append(hexes[2 * BYTES * first:2 * BYTES * k])
            right.append(hexes[2 * BYTES * (k + 1):2 * BYTES * min(first + FANOUT, count)])
        count = -(-count // FANOUT)
    return left, right, np.array(steps, np.int64).reshape(levels - 1, leaves).T


# ------------------------------------------------------------------------ the tree as tables

@dataclass
class Manifest:
    """``leaves``: the rows with ``__tree``, ``__index``, ``__size`` and ``__digest``. ``blocks``: for every tree, pass and block its ``nodes``
    in van Emde Boas order. ``top``: the blocks of the tree over the roots of the parts. ``parts``: the number and root of every part.
    All but ``leaves`` are written tables."""
    leaves: DataFrame
    blocks: list[DataFrame]
    parts: DataFrame
    top: list[DataFrame]


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (written) with ``__index`` in their tree by ``order`` and ``__size`` of the tree. Rows are dealt out by ranges
    and counted per partition and tree; the counts alone meet in windows."""
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())  # equal rows need not be in one partition
    sorted_rows = spread.repartitionByRange(tree, *order, "__spread").sortWithinPartitions(tree, *order, "__spread")
    placed = materialize(sorted_rows.drop("__spread").withColumns({
        "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "merkle-order")
    counts = placed.groupBy(tree, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    window = "PARTITION BY `{0}` ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING".format(tree)
    counts = materialize(counts.select(
        F.col(tree).alias("__t"), F.col("__part").alias("__p"), "__first",
        F.coalesce(F.expr(f"sum(__n) OVER ({window})"), F.lit(0)).alias("__before"),
        F.expr(f"sum(__n) OVER (PARTITION BY `{tree}`)").alias("__size")), "merkle-counts")
    joined = placed.join(broadcast_below(counts), F.col(tree).eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("__index", F.col("__at") - F.col("__first") + F.col("__before")).drop(
        "__part", "__at", "__t", "__p", "__first", "__before")


def _build(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, roots = [], []
        for size, leaves in zip(batch.column("size").to_pylist(), batch.column("leaves")):
            digests = [bytes.fromhex(x["digest"]) for x in sorted(leaves.as_py(), key=lambda x: x["index"])]
            made.append(build_block(digests, block_levels(len(digests), size <= FANOUT ** height, height)))
            roots.append(made[-1][:BYTES].hex())
        yield pa.record_batch([batch.column("tree"), batch.column("block"), batch.column("size"), pa.array(made, pa.binary()),
                               pa.array(roots, pa.string())], ["tree", "block", "size", "nodes", "block_root"])


def _in_blocks(nodes: DataFrame, height: int, *more: str) -> DataFrame:
    """A row per block: its leaves, at most ``FANOUT`` ** ``height``, with what they carry."""
    return (nodes.groupBy("tree", F.expr(f"index div {FANOUT ** height}").alias("block"))
            .agg(F.first("size").alias("size"), F.collect_list(F.struct("index", "digest", *more)).alias("leaves")))


def build_tree(nodes: DataFrame, kind: str, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Blocks by pass, and ``tree`` and ``digest`` of the roots, for nodes with ``tree``, ``index``, ``size`` and ``digest``."""
    leaves = FANOUT ** height
    most = nodes.agg(F.max("size")).first()[0] or 0
    small_batches(nodes.sparkSession)
    blocks, roots = [], []
    while True:
        made = _in_blocks(nodes, height).mapInArrow(
            lambda b: _build(b, height), f"tree {kind}, block bigint, size bigint, nodes binary, block_root string")
        blocks.append(materialize(made, "merkle-blocks"))
        above = blocks[-1].select("tree", F.col("block").alias("index"), F.expr(f"(size + {leaves - 1}) div {leaves}").alias("size"),
                                  F.col("block_root").alias("digest"))
        roots.append(above.where("size = 1").select("tree", "digest"))
        if most <= leaves:
            break
        nodes, most = above.where("size > 1"), -(-most // leaves)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return blocks, out


def build_manifest(rows: DataFrame, part: str, order: Sequence[str], leaf: str, height: int = HEIGHT) -> Manifest:
    """The manifest of rows with a hex digest ``leaf``, in trees by ``part`` with leaves ordered by ``order``."""
    kind = rows.schema[part].dataType.simpleString()
    kept = [c for c in rows.columns if c not in ADDED]
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(f"`{part}`").alias("__tree"),
                       F.col(f"`{leaf}`").alias("__digest"), *[F.col(f"`{c}`").alias(f"__key{k}") for k, c in enumerate(order)])
    keys = [f"__key{k}" for k in range(len(order))]
    leaves = numbered(materialize(held, "merkle-leaves"), "__tree", [*keys, "__digest"]).drop(*keys)
    nodes = leaves.select(*[F.col(f"__{c}").alias(c) for c in ("tree", "index", "size", "digest")])
    blocks, roots = build_tree(nodes, kind, height)
    tops = numbered(materialize(roots.withColumn("top", F.lit(0)), "merkle-parts"), "top", ["tree"])
    parts = materialize(tops.select("tree", "digest", "top", F.col("__index").alias("index"), F.col("__size").alias("size")),
                        "merkle-roots")
    top, _ = build_tree(parts.select(F.col("top").alias("tree"), "index", "size", "digest"), "int", height)
    return Manifest(leaves, blocks, parts, top)


# ------------------------------------------------------------------------ proofs

def _prove(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves = batch.column("leaves")
        for k in range(batch.num_rows):
            members = leaves[k].values
            index = members.field("index").to_numpy(zero_copy_only=False)
            n, levels = len(members), block_levels(len(members), batch.column("size")[k].as_py() <= FANOUT ** height, height)
            left, right, steps = block_paths(batch.column("nodes")[k].as_py(), n, levels)
            further = batch.column("further")[k].values
            table = pa.concat_arrays([
                pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(STEP)),
                further.cast(STEP)])
            up = len(left) + np.arange(len(further))
            chosen = np.hstack([steps[index % FANOUT ** height], np.broadcast_to(up, (n, len(up)))]).astype(np.int64)
            proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * chosen.shape[1], pa.int32()), table.take(pa.array(chosen.ravel())))
            roots = [pa.array([batch.column(c)[k].as_py()] * n, pa.string()) for c in ("subroot", "root")]
            yield pa.record_batch([members, proof, *roots], ["leaf", "proof", "subroot", "root"])


def _down(nodes: DataFrame, blocks: DataFrame, further: DataFrame, height: int, more: Sequence[str] = ()) -> DataFrame:
    """For every node its proof: the siblings in its block, followed by the proof of the block's root in ``further``
    (``tree``, ``block``, ``further``, ``subroot``, ``root``)."""
    grouped = _in_blocks(nodes, height, *more)
    kind = grouped.schema["leaves"].dataType.elementType.simpleString()

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({"tree": f"tree_{name}", "block": f"block_{name}"})

    def same(name: str) -> Column:
        return F.col("tree").eqNullSafe(F.col(f"tree_{name}")) & (F.col("block") == F.col(f"block_{name}"))

    joined = (grouped.join(named(blocks.select("tree", "block", "nodes"), "b"), same("b"))
              .join(named(further, "f"), same("f")).select("size", "leaves", "nodes", "further", "subroot", "root"))
    return joined.mapInArrow(lambda b: _prove(b, height), f"leaf {kind}, proof {PROOF}, subroot string, root string")


def prove(manifest: Manifest, height: int = HEIGHT) -> DataFrame:
    """The rows with the root of their part, the root of all, and ``proof``: for every level up to the root the hex digests of
    the siblings to the left and to the right."""
    small_batches(manifest.leaves.sparkSession)
    none = F.array().cast(PROOF)

    def descend(blocks: list[DataFrame], start: DataFrame, nodes: DataFrame, more: Sequence[str]) -> DataFrame:
        """``start``: proofs of the trees' roots (``tree``, ``further``, ``subroot``, ``root``). A tree ends at the pass at which it has one
        block; its proof starts there."""
        further = None
        for number in range(len(blocks) - 1, -1, -1):
            here = blocks[number]
            last = here.where(f"size <= {FANOUT ** height}").select(F.col("tree").alias("t"), "block")
            begun = last.join(start, F.col("t").eqNullSafe(F.col("tree"))).select("tree", "block", "further", "subroot", "root")
            further = begun if further is None else begun.unionByName(further)
            if number == 0:
                return _down(nodes, here, further, height, more)
            below = blocks[number - 1].where(f"size > {FANOUT ** height}").select(
                "tree", F.col("block").alias("index"), F.expr(f"(size + {FANOUT ** height - 1}) div {FANOUT ** height}").alias("size"),
                F.col("block_root").alias("digest"), F.col("tree").alias("of"))
            proved = _down(below, here, further, height, ("of",))
            further = materialize(proved.select(F.col("leaf.of").alias("tree"), F.col("leaf.index").alias("block"),
                                                F.col("proof").alias("further"), "subroot", "root"), "merkle-proofs")

    parts = manifest.parts.select(F.col("top").alias("tree"), "index", "size", "digest", F.col("tree").alias("part"))
    # the root of all stands first in the only block of the last pass
    root = manifest.top[-1].select("tree", none.alias("further"), F.lit("").alias("subroot"), F.col("block_root").alias("root"))
    tops = descend(manifest.top, root, parts, ("part",))
    start = materialize(tops.select(F.col("leaf.part").alias("tree"), F.col("proof").alias("further"),
                                    F.col("leaf.digest").alias("subroot"), "root"), "merkle-proofs")
    nodes = manifest.leaves.select(*[F.col(f"__{c}").alias(c) for c in ("tree", "index", "size", "digest", "row")])
    proved = descend(manifest.blocks, broadcast_below(start), nodes, ("row",))
    return proved.select("leaf.row.*", "subroot", "root", "proof")


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings on the way up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))

