import hashlib
import random
import zlib

import pytest
from helpers import ODD, F, docs

from tallyloom.llm import catalog, merkle as M

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, k):
    out = []
    for row in levels[:-1]:
        first = k - k % 8
        out.append((row[first:k], row[k + 1:first + 8]))
        k //= 8
    return out


def by_hand(rows):
    """(part, key, leaf) -> subroot, root and siblings of every row; rows that agree in part and key by leaf."""
    order = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)
    parts = {}
    for part, key, digest in rows:
        parts.setdefault(part, []).append((order(key), digest))
    names = sorted(parts, key=lambda p: b"" if p is None else b"\1" + p.encode())
    trees = {p: tree([d for _, d in sorted(parts[p])]) for p in names}
    top = tree([trees[p][-1][0] for p in names])
    out = {}
    for n, p in enumerate(names):
        for k, (_, digest) in enumerate(sorted(parts[p])):
            out.setdefault((p, digest), []).append((trees[p][-1][0], top[-1][0], siblings(trees[p], k) + siblings(top, n)))
    return out


def test_places_are_a_permutation_and_subtrees_are_contiguous():
    for levels in range(1, 7):
        at = [M.place(levels, d, k) for d in range(levels) for k in range(M.FANOUT ** d)]
        assert sorted(at) == list(range(M.nodes_of(levels)))
        upper = levels // 2
        if upper:
            assert sorted(M.place(levels, d, k) for d in range(upper) for k in range(M.FANOUT ** d)) == list(range(M.nodes_of(upper)))
            size = M.nodes_of(levels - upper)
            for k in (0, M.FANOUT ** upper - 1):  # the first and the last lower subtree
                own = [M.place(levels, upper + d, k * M.FANOUT ** d + j) for d in range(levels - upper) for j in range(M.FANOUT ** d)]
                start = M.nodes_of(upper) + k * size
                assert sorted(own) == list(range(start, start + size))
                assert [x - start for x in own] == [M.place(levels - upper, d, j) for d in range(levels - upper) for j in range(M.FANOUT ** d)]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_against_plain_trees(spark, height):
    """Trees of one leaf, of a full run, of short last runs and of several passes; keys that tie; a null part and null keys."""
    rng = random.Random(height)
    rows = []
    for part, n in ((None, 9), ("", 1), ("a", 8), ("b", 65), ("é", 64), ("z", 600), ("Z", 3)):
        rows += [(part, rng.choice([None, rng.randrange(300)]), H(str(rng.randrange(10 ** 6 if k % 7 else 3)))) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "part string, key int, digest string, root string, proof string")
    got = M.prove(M.build_manifest(df.repartition(5), "part", ["key"], "digest", height), height)
    assert got.columns == ["part", "key", "digest", "subroot", "root", "proof"]
    want, found = by_hand(rows), {}
    for r in got.withColumns({"folded": M.fold(F.col("digest"), F.col("proof")), "all": M.siblings_digest(F.col("proof"))}).collect():
        found.setdefault((r["part"], r["digest"]), []).append(
            (r["subroot"], r["root"], [("".join(s["left"]), "".join(s["right"])) for s in r["proof"]]))
        assert r["folded"] == r["root"]
        assert r["all"] == H(*[s["left"] + s["right"] for s in r["proof"]])
    flat = {k: sorted((s, r, [("".join(a), "".join(b)) for a, b in p]) for s, r, p in v) for k, v in want.items()}
    assert {k: sorted(v) for k, v in found.items()} == flat


def test_blocks_hold_all_nodes(spark):
    """The nodes of a block, read by address, are those of the plain tree, and the next pass goes over the roots."""
    rows = [("p", k, H(str(k))) for k in range(100)]
    made = M.build_manifest(spark.createDataFrame(rows, "part string, key int, digest string"), "part", ["key"], "digest", 1)
    levels = tree([d for _, _, d in rows])
    for number, blocks in enumerate(made.blocks):
        stored = {r["block"]: bytes(r["nodes"]) for r in blocks.collect()}
        assert len(stored) == len(levels[number + 1])
        for k, digest in enumerate(levels[number]):
            at = M.place(2, 1, k % 8) * M.BYTES
            assert stored[k // 8][at:at + M.BYTES].hex() == digest
        assert [stored[k][:M.BYTES].hex() for k in sorted(stored)] == levels[number + 1]
    assert len(made.blocks) == len(levels) - 1


def test_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("leaf", M.leaf_digest(F.col("doc_id"), F.col("text")))
    got = M.prove(M.build_manifest(rows, "lang", ["doc_id"], "leaf")).collect()
    want = by_hand([("en", i, leaf((i, t))) for i, t in ODD])
    assert len(got) == len(ODD) and {(r["lang"], r["leaf"]) for r in got} == set(want)
    assert len({r["root"] for r in got}) == 1 == len({v[0][1] for v in want.values()} | {r["root"] for r in got})
    empty = M.prove(M.build_manifest(rows.limit(0), "lang", ["doc_id"], "leaf"))
    assert empty.count() == 0 and empty.columns == [*rows.columns, "subroot", "root", "proof"]
    one = M.prove(M.build_manifest(rows.where("doc_id = 4"), "lang", ["doc_id"], "leaf")).first()
    assert one["root"] == one["subroot"] == one["leaf"] and one["proof"] == []


def test_query_against_brute_force(spark):
    source = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])
              for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = by_hand([(r[2], r[0], leaf(r)) for r in source])
    got = {r["doc_id"]: r for r in catalog.op11_merkle_manifest(spark, SF).collect()}
    assert len(got) == len(source)
    changed = 0
    for r in source:
        out, ((subroot, root, proof),) = got[r[0]], want[r[2], leaf(r)]
        now = leaf(r)
        if zlib.crc32(str(r[0]).encode()) % 3 == 0:
            now = leaf((*r[:4], r[4].translate({k: k + 32 for k in range(65, 91)})))
        for a, b in proof:
            now = H(*a, now, *b)
        assert out[1:] == (leaf(r), subroot, root, H(*[x for a, b in proof for x in a + b]), now, now == root)
        changed += now != root
    assert 0 < changed < len(source) / 2
