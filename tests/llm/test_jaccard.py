import random

import numpy as np
from helpers import ODD, check_odd, docs

from tallyloom.llm import jaccard as J


def classes(rows):
    """Class and number of links of every row, by comparing all pairs of sets of five-grams."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [[] for _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared >= J.THRESHOLD * len(sets[a] | sets[b]) - 1e-9:
                links[a].append(b)
                links[b].append(a)
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, least.get(root(k), i), len(links[k])) for k, (i, _) in enumerate(rows)), key=str)


def found(spark, rows):
    return sorted(((r["doc"], r["class_id"], r["n_links"]) for r in J.near_copies(docs(spark, rows)).collect()), key=str)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(text) if rng.random() < 0.9 else " ".join(text).upper()))
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1, 70, 9)
    got, want = found(spark, rows), classes(rows)
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(rows)
    assert sum(n for *_, n in got) >= J.RECALL * sum(n for *_, n in want)


def test_nodes_above_the_block_size(spark, monkeypatch):
    """Small blocks: large nodes are split to the last level and cut, and groups are compared in pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = corpus(2, 6, 40)
    got, want = found(spark, rows), classes(rows)
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(rows)


def test_survival_and_runs():
    assert J._survival(1) > J._survival(6) > 0.3
    assert 1 - (1 - J._survival(J.DEPTH)) ** J.runs_for(0.99) >= 0.99
    rng = np.random.RandomState(1)
    both = rng.randint(0, 1 << 62, 8000).astype(np.uint64)
    a, b = J.sketch(np.unique(both)), J.sketch(np.unique(both[800:]))
    assert abs((a == b).mean() - 0.9) < 0.15


def test_odd_rows(spark):
    out = check_odd(spark, J.near_copies)
    got = sorted(((r["doc"], r["class_id"], r["n_links"]) for r in out.collect()), key=str)
    assert got == classes(ODD)


def test_exact_copies(spark):
    rows = [(k, "exactly the same text in all of these rows") for k in range(500)] + [(900, "another text " * 3)]
    got = {d: (c, n) for d, c, n in found(spark, rows)}
    assert all(got[k] == (0, 499) for k in range(500)) and got[900] == (900, 0)
