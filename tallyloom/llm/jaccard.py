"""Near copies of documents: a chosen-path join on sets of word five-grams, Jaccard similarity 0.8 or more.

Documents with equal sets are collapsed first. Each remaining set is mapped to ``WIDTH`` minimum hashes: a
coordinate samples one element, and two sets share the sample with a probability equal to their similarity. A run
starts with all sets in one node; a node picks one coordinate by a hash of its path (with probability 1/4 a second one, so
that 1 / 0.8 are picked on average) and splits into the sets with equal values there. Nodes of one set end, nodes of at most
``BLOCK`` sets are compared by brute force, larger ones are split again, and after ``DEPTH`` levels cut into pairs
of blocks. ``runs_for`` says how many runs reach the target recall even at the last level.

Brute force compares the minimum hashes; what may be similar is linked. The links' connected components are then
compared exactly, in pairs of blocks of sets, which gives each document's number of links and the final classes. A group
leaves a task as one edge and one count per member, never as pairs. Equal sets are told by a 64-bit hash.

Edge cases: a null text counts as empty; a text without words is similar to nothing and a class of its own; a
text of fewer than five words is one gram; rows with equal ids are separate rows of equal class if their texts
are similar; a null id is kept; an empty table gives an empty result; other columns are not looked at.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.arrow import small_batches
from tallyloom.llm.common import broadcast_below
from tallyloom.llm.runs import sorted_runs
from tallyloom.llm.urls import connected_components
from tallyloom.plans.small import materialize

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.99
WIDTH = 64
DEPTH = 6
BLOCK = 256
SECOND = 0.25                 # probability that a node splits by two coordinates
SKETCH_MARGIN = 4.0           # standard deviations below the threshold that still count as similar
_WORDS_HELD = 1 << 16

_random = np.random.RandomState(20240229)
_MULTIPLY = (_random.randint(0, 1 << 62, WIDTH).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _random.randint(0, 1 << 62, WIDTH).astype(np.uint64)
#: Odd multipliers of the hashes.
_P = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _WordHashes()


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-grams of the lower-cased words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = max(1, len(w) - GRAM + 1)
    h = np.zeros(size, np.uint64)
    for k in range(min(GRAM, len(w))):
        h = (h + w[k:k + size]) * _P[k]
        h ^= h >> np.uint64(31)
    return np.unique(h * _P[5])


def sketch(s: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, 32 bits each."""
    least = np.full(WIDTH, (1 << 32) - 1, np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a:a + 4096, None]
        least = np.minimum(least, ((part * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def _survival(depth: int) -> float:
    """Probability that a pair at the threshold is still together somewhere after ``depth`` levels of a run."""
    p = 1.0
    for _ in range(depth):
        one = THRESHOLD * p
        p = (1 - SECOND) * one + SECOND * (1 - (1 - one) ** 2)
    return p


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - _survival(depth)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P[1]
    return x ^ (x >> np.uint64(27))


def _split(paths: np.ndarray, sketches: np.ndarray, set_ids: np.ndarray) -> pa.RecordBatch:
    """The child nodes of sets (rows of ``sketches``) in the nodes ``paths``."""
    draw = _mix(paths * _P[0] + np.uint64(1))
    one = (draw % np.uint64(WIDTH)).astype(np.int64)
    shift = (draw >> np.uint64(8)) % np.uint64(WIDTH - 1) + np.uint64(1)
    two = (one + shift.astype(np.int64)) % WIDTH
    twice = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < SECOND
    rows = np.arange(len(paths))
    children, owners = [], []
    for which, at, rows in ((0, one, rows), (1, two, rows[twice])):
        value = sketches[rows, at[rows]].astype(np.uint64)
        children.append(_mix((paths[rows] ^ (value * _P[2])) * _P[3] + at[rows].astype(np.uint64) * np.uint64(2) + np.uint64(which)))
        owners.append(set_ids[rows])
    return pa.record_batch([pa.array(np.concatenate(children).view(np.int64)), pa.array(np.concatenate(owners))], ["path", "sid"])


def _set_id(packed: bytes) -> int | None:
    return xxhash.xxh3_64_intdigest(packed) - (1 << 63) if packed else None


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [grams(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch([
            batch.column(0), pa.array([_set_id(s.tobytes()) for s in sets], pa.int64()),
            pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc", "sid", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [grams(t.as_py()).tobytes() for t in batch.column(0)]
        yield pa.record_batch([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["sid", "grams"])


def _roots(runs: int):
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sketches = _matrix(batch.column(1).to_pylist())
            for run in range(runs):
                yield _split(np.full(len(ids), run, np.uint64), sketches, ids)
    return start


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _split(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2).to_pylist()), batch.column(1).to_numpy())


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), WIDTH)


def _nodes(last: bool, most: int):
    """Sorts nodes out: ``side`` 2 for a node to be compared with itself, 0 and 1 for the blocks of a pair, 3 for a node
    to be split further."""
    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, sides, size = [], [], [], 0
        for path, own in sorted_runs(batches, 2):
            own = np.unique(own)
            if len(own) < 2:
                continue
            if len(own) <= most or not last:
                members = [(int(path[0]), own, 2 if len(own) <= most else 3)]
            else:
                blocks = [own[s:s + most] for s in range(0, len(own), most)]
                members = []
                for i, a in enumerate(blocks):
                    for j in range(i, len(blocks)):
                        name = xxhash.xxh3_64_intdigest(f"{path[0]}:{i}:{j}") - (1 << 63)
                        members += [(name, a, 2)] if i == j else [(name, a, 0), (name, blocks[j], 1)]
            for name, block, side in members:
                names.append(np.full(len(block), name, np.int64))
                ids.append(block)
                sides.append(np.full(len(block), side, np.int8))
                size += len(block)
            if size > 100_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (names, ids, sides)], ["path", "sid", "side"])
                names, ids, sides, size = [], [], [], 0
        if size:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (names, ids, sides)], ["path", "sid", "side"])
    return sort_out


class _Forest:
    """Joins the members of a group by links; every member's root is the least linked position."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _similar_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One edge per member of a node that may be similar to another: to the least member linked with it."""
    need = WIDTH * (THRESHOLD - SKETCH_MARGIN * math.sqrt(THRESHOLD * (1 - THRESHOLD) / WIDTH))
    for _, own, sides, sketches in sorted_runs(batches, 4):
        matrix, forest = _matrix(list(sketches)), _Forest(len(own))
        for b in range(1, len(own)):
            same = (matrix[:b] == matrix[b]).sum(axis=1)
            for a in np.flatnonzero((same >= need) & ((sides[:b] != sides[b]) | (sides[:b] == 2)) & (own[:b] != own[b])):
                forest.link(int(a), b)
        edges = [(own[k], own[r]) for k in range(len(own)) if (r := forest.root(k)) != k]
        if edges:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], ["src", "dst"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity inside groups: ``sid``, ``links`` (documents of the sets linked to it here) and ``root`` (one set that it is
    connected with). The intersections of a set with all others of its group are one pass over their grams."""
    for _, own, sides, copies, sets in sorted_runs(batches, 5):
        arrays = [np.frombuffer(x, np.uint64) for x in sets]
        sizes = np.array([len(x) for x in arrays])
        _, local = np.unique(np.concatenate(arrays), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held, links, forest = np.zeros(local.max() + 1, np.int32), np.zeros(len(own), np.int64), _Forest(len(own))
        for b in range(len(own)):
            mine = local[starts[b]:starts[b] + sizes[b]]
            held[mine] = 1
            shared = np.add.reduceat(held[local], starts)
            held[mine] = 0
            union = sizes + sizes[b] - shared
            linked = (shared >= THRESHOLD * union - 1e-9) & ((sides != sides[b]) | (sides == 2)) & (own != own[b])
            links[b] = copies[linked].sum()
            for a in np.flatnonzero(linked[:b]):
                forest.link(int(a), b)
        roots = [own[forest.root(k)] for k in range(len(own))]
        yield pa.record_batch([pa.array(own), pa.array(links), pa.array(roots, pa.int64())], ["sid", "links", "root"])


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``class_id`` (the least id of its connected near copies), ``copy_id`` (the least id
    of the documents with the same grams) and ``n_links`` (the other documents with a similarity of at least 0.8)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    marks = materialize(texts.mapInArrow(_mark, f"doc {kind}, sid bigint, sketch binary"), "gram-marks")
    sets = materialize(marks.where("sid is not null").groupBy("sid").agg(
        F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch")), "gram-sets")
    sketches = sets.select("sid", "sketch")

    def sorted_out(nodes: DataFrame, level: int) -> DataFrame:
        return materialize(nodes.repartition(parts, "path").sortWithinPartitions("path")
                           .mapInArrow(_nodes(level == DEPTH, BLOCK), "path bigint, sid bigint, side tinyint"), f"nodes-{level}")

    level = sorted_out(sketches.mapInArrow(_roots(runs_for(recall)), "path bigint, sid bigint"), 1)
    leaves = level.where("side < 3")
    for depth in range(2, DEPTH + 1):
        large = level.where("side = 3")
        if large.isEmpty():
            break
        level = sorted_out(large.select("path", "sid").join(sketches, "sid").select("path", "sid", "sketch")
                           .mapInArrow(_deeper, "path bigint, sid bigint"), depth)
        leaves = leaves.union(level.where("side < 3"))

    maybe = (leaves.join(sketches, "sid").select("path", "sid", "side", "sketch")
             .repartition(parts, "path").sortWithinPartitions("path")
             .mapInArrow(_similar_sketches, "src bigint, dst bigint"))
    groups = connected_components(maybe).select(F.col("node").alias("sid"), "component")
    exact = materialize(_exact(texts, groups, sets, parts), "gram-links")
    classes = connected_components(exact.where("sid <> root").select(F.col("sid").alias("src"), F.col("root").alias("dst")))
    counts = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    known = (sets.select("sid", "first", "copies").join(counts, "sid", "left")
             .join(classes.select(F.col("node").alias("sid"), "component"), "sid", "left")
             .withColumn("component", F.coalesce("component", "sid")))
    named = known.join(known.groupBy("component").agg(F.min("first").alias("class_id")), "component").select(
        "sid", "first", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return marks.select("doc", "sid").join(named, "sid", "left").select(
        "doc", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("first", "doc").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _exact(texts: DataFrame, groups: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """``sid``, ``links``, ``root`` of the sets in ``groups``. A group of more than BLOCK sets is dealt to blocks by a hash; each
    pair of blocks is compared in a group of its own."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = (groups.join(sizes, "component").join(sets.select("sid", "first", "copies"), "sid")
               .withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks"))))
    members = materialize(members, "gram-groups")
    wanted = broadcast_below(members.select(F.col("first").alias("__doc")))
    grams_of = (texts.join(wanted, F.col("doc").eqNullSafe(F.col("__doc")), "left_semi").select("text")
                .mapInArrow(_sets, "sid bigint, grams binary").groupBy("sid").agg(F.any_value("grams").alias("grams")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = members.select("*", other).select(
        "sid", "copies", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("tinyint").alias("side"))
    return (tiles.join(grams_of, "sid").select("tile", "sid", "side", "copies", "grams")
            .repartition(parts, "tile").sortWithinPartitions("tile")
            .mapInArrow(_compare, "sid bigint, links bigint, root bigint"))
