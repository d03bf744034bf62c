import random
import time

import numpy as np
import pyarrow as pa
from helpers import F, ODD, by_id, check_odd, docs

import corpus_pipeline
from tallyloom.llm import lines as L
from tallyloom.llm.runs import whole_runs
from tallyloom.plans.small import shuffles_removed


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def removed(rows):
    """Line numbers that go, by comparing each line with all earlier ones; earlier ids first, null the first."""
    seen, out = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[k] = []
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip()
            if len(line) >= L.MIN_CHARS:
                if any(abs(len(line) - len(s)) <= L.TAU and distance(s, line) <= L.TAU for s in seen):
                    out[k].append(n)
                seen.append(line)
    return out


def test_bounded_distance_and_probes():
    rng = random.Random(2)
    for _ in range(8000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(10)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        d = distance(a, b)
        assert L.bounded_distance(a, b) == (d if d <= L.TAU else None)
        long, short = sorted((a, b), key=len, reverse=True)
        if d <= L.TAU < len(short):
            cut = L.segments(len(short))
            assert any(long[s:s + n] == short[cut[k][0]:cut[k][0] + n] for k, s, n in L.probes(len(long), len(short)))


def corpus(rng):
    rows = []
    for k in range(60):
        own = []
        for _ in range(rng.randrange(6)):
            line = list(f"line {rng.randrange(25)} of the {rng.choice(['first', 'second'])} kind, as long as others")
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(["", "q", "zz"])
            own.append(rng.choice(["", " "]) + "".join(line))
            own += rng.choice([[], ["short"], [""], ["  "]])
        rows.append((k, "\n".join(own)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(random.Random(7))
    got = by_id(L.dedup_lines(docs(spark, rows)))
    want = removed(rows)
    for k, t in rows:
        assert got[k]["removed"] == want[k]
        assert got[k]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k])
        assert got[k]["n_lines"] == len(t.split("\n")) and got[k]["n_removed"] == len(want[k])


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """All lines share a segment, so they meet in pairs of small blocks."""
    monkeypatch.setattr(L, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(k, "the same beginning of every line " + "".join(rng.choice("ab") for _ in range(9))) for k in range(60)]
    groups = spark.createDataFrame([(1, L.line_id(t), True) for _, t in rows], "key long, id long, indexed boolean")
    made = groups.coalesce(1).sortWithinPartitions("key").mapInArrow(lambda b: L._groups(b, 4), "group bigint, id bigint, side tinyint")
    pairs = made.alias("a").join(made.alias("b"), F.expr("a.group = b.group and a.id < b.id and (a.side <> b.side or a.side = 2)"))
    n = len({t for _, t in rows})
    assert pairs.select("a.id", "b.id").distinct().count() == n * (n - 1) // 2 == pairs.count()
    got = by_id(L.dedup_lines(docs(spark, rows)))
    assert {k: r["removed"] for k, r in got.items()} == removed(rows)


def test_counts_keep_all_near_lines(spark):
    """Of a group, members without a line near in counts go; sides hold, and counts beyond 255 do no harm."""
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(120)) + "." for _ in range(8)]
    lines += [lines[0][:50] + "zz" + lines[0][52:], lines[1] + "!", "a" * 900 + "." + "b" * 300, "a" * 890 + "." + "b" * 310 + "."]
    sketch = "id bigint, size int, c0 bigint, c1 bigint, c2 bigint, c3 bigint"
    made = docs(spark, [(0, "\n".join(lines))]).select("text").mapInArrow(L._sketches, sketch)
    members = spark.createDataFrame([(g, L.line_id(x), side(k)) for g, side in ((1, lambda k: 2), (2, lambda k: int(k > 7))) for k, x in enumerate(lines)]
                                    + [(3, L.line_id(x), 0) for x in lines], "group long, id long, side byte")
    kept = (members.join(made, "id").select("group", "id", "side", "size", *L._COUNTS).coalesce(1).sortWithinPartitions("group")
            .mapInArrow(L._narrow, "group bigint, id bigint, side tinyint").collect())
    near = {L.line_id(lines[k]) for k in (0, 1, 8, 9)}
    assert {r["id"] for r in kept if r["group"] == 1} == near | {L.line_id(lines[k]) for k in (10, 11)}
    assert {r["id"] for r in kept if r["group"] == 2} == near and not [r for r in kept if r["group"] == 3]


def test_odd_rows(spark):
    out = check_odd(spark, L.dedup_lines)
    want = removed([r for r in ODD if r[0] != 5]) | {5: []}  # rows with one id are one document
    assert {r["doc_id"]: r["removed"] for r in out.collect()} == want


def test_copies_lose_all_lines(spark):
    text = "a line that is long enough\nand a second one, long enough"
    got = by_id(L.dedup_lines(docs(spark, [(2, text), (1, text), (3, text + "\nand a third one that is new")])))
    assert got[1]["removed"] == [] and got[2]["text"] == "" and got[3]["text"] == "and a third one that is new"


def near_removed(rows):
    """As ``removed``, with the edits that the shorter line bears."""
    seen, out = [], {}
    for k, t in rows:
        out[k] = []
        for n, line in enumerate(t.split("\n")):
            bears = [(s, L.threshold(min(len(s), len(line)))) for s in seen]
            if any(abs(len(line) - len(s)) <= e and distance(s, line) <= e for s, e in bears):
                out[k].append(n)
            seen.append(line)
    return out


def stage_removed(rows):
    """What goes with ``min_chars=1``: from MIN_CHARS characters on a line near any earlier one, below it a line with a word that
    equals an earlier one. Every earlier line is compared; only those of a length out of reach are passed over."""
    by_length, short, out = {}, set(), {}
    for k, t in sorted(rows):
        out[k] = []
        for n, line in enumerate(t.split("\n")):
            line = line.strip()
            if len(line) >= L.MIN_CHARS:
                reach = L.threshold(len(line))
                if any(L.bounded_distance(s, line, L.threshold(min(size, len(line)))) is not None
                       for size in range(len(line) - reach, len(line) + 2 * reach + 1) for s in by_length.get(size, ())):
                    out[k].append(n)
                by_length.setdefault(len(line), set()).add(line)
            elif any(map(str.isalnum, line)):
                if line in short:
                    out[k].append(n)
                short.add(line)
    return out


def edited(rng, line, edits, signs):
    line = list(line)
    for _ in range(edits):
        k = rng.randrange(len(line))
        line[k:k + rng.randrange(2)] = rng.choice(["", rng.choice(signs)])
    return "".join(line).strip()


def test_bounded_distance_of_long_lines():
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(90, 200)))
        b, tau = edited(rng, a, rng.randrange(9), "abq"), rng.randrange(1, 8)
        d = distance(a, b)
        assert L.bounded_distance(a, b, tau) == (d if d <= tau else None)


def test_banded_distance_at_any_width():
    rng = random.Random(4)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        b = edited(rng, a, min(rng.randrange(12), len(a) - 1), "abcd") if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        tau = rng.randrange(1, 45)
        if b and abs(len(a) - len(b)) <= tau:
            d = distance(a, b)
            assert L._banded(a, b, tau) == L.bounded_distance(a, b, tau) == (d if d <= tau else None), (a, b, tau)


def test_lines_of_a_million_characters():
    """Few edits cost a narrow band, and lines that differ early are given up early."""
    rng = random.Random(6)
    a = "".join(rng.choices("abcdefgh ", k=1_000_000))
    b = "x" + a[1:400_000] + a[400_001:900_000] + "yy" + a[900_000:-1] + "z"
    began = time.process_time()
    assert L.bounded_distance(a, b, L.threshold(len(a))) == 5
    c = "".join(rng.choices("ijklmnop ", k=1_000_000))
    assert L.bounded_distance(a, c, 500) is None
    assert time.process_time() - began < 20


def test_near_copies_share_a_chunk():
    rng = random.Random(3)
    for signs in ("abcdefg  ", "ab", "一丁三四五", "x"):
        for _ in range(300):
            a = "".join(rng.choice(signs) for _ in range(rng.randrange(L.LONG, 400))).strip()
            b = edited(rng, a, rng.randrange(L.threshold(len(a)) + 1), signs)
            d = distance(a, b) if len(a) < 150 else None
            if min(len(a), len(b)) < L.LONG or L.bounded_distance(a, b, L.threshold(min(len(a), len(b)))) is None:
                continue
            assert d is None or L.bounded_distance(a, b, d) == d
            keys = [{(level, part): (main, at) for level, main, found in L.chunks(x) for part, at in found} for x in (a, b)]
            edits = L.threshold(min(len(a), len(b)))
            assert any((keys[0][c][0] or keys[1][c][0]) and (min(keys[0][c][1], keys[1][c][1]) < 0 or
                       abs(keys[0][c][1] - keys[1][c][1]) <= edits) for c in keys[0].keys() & keys[1].keys())


def test_changed_words_in_long_lines(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for k in range(12):
        own = [rng.choice(words) for _ in range(rng.randrange(16, 70))]
        rows.append((len(rows), " ".join(own)))
        for changed in (1, 2, 3, 12):
            copy = list(own)
            for _ in range(changed):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {k: r["removed"] for k, r in by_id(L.dedup_lines(docs(spark, rows))).items()}
    assert got == near_removed(rows)
    assert sum(len(v) for v in got.values()) >= 12
    line = " ".join(words[:60])  # about 340 characters
    three = " ".join("other" if k in (7, 30, 51) else w for k, w in enumerate(words[:60]))
    two = line.replace(words[10], words[10][::-1], 1)
    got = by_id(L.dedup_lines(docs(spark, [(1, line), (2, two), (3, three)])))
    assert got[2]["removed"] == [0]
    assert (got[3]["removed"] == [0]) == (distance(line, three) <= L.threshold(min(len(line), len(three))) or
                                          distance(two, three) <= L.threshold(min(len(two), len(three))))


def test_copies_with_short_lines_go(spark):
    """Exact copies end empty, and the stage drops them; short lines are not compared by edits."""
    text = "Les.\n\na line that is long enough to count\n---\nAnd ornd."
    rows = [(1, text), (2, text), (3, "Lex.\na line of its own that nobody else has"), (4, "***\n"), (5, "Les.\n---\n\n")]
    got = by_id(L.dedup_lines(docs(spark, rows), min_chars=1))
    assert {k: r["removed"] for k, r in got.items()} == {1: [], 2: [0, 2, 4], 3: [], 4: [], 5: [0]}
    assert set(by_id(corpus_pipeline.line_dedup(spark, docs(spark, rows), ""))) == {1, 3, 4}


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 12))) for _ in range(n)]


def test_pairs_side_by_side_are_near_as_one_by_one():
    rng, pairs = random.Random(11), []
    for signs in ("ab", "abcdefgh ", "".join(map(chr, range(0x4E00, 0x5200)))):
        for _ in range(700):
            a = "".join(rng.choice(signs) for _ in range(rng.randrange(20, 260)))
            b = edited(rng, a, rng.randrange(16), signs + "q") if rng.random() < 0.9 else "".join(rng.choice(signs) for _ in range(len(a)))
            pairs.append((a, b or "q", rng.randrange(1, 14)))
    pairs.append(("x" * 9000, "x" * 4000 + "y" + "x" * 5001, 3))
    assert L._near_pairs(pairs).tolist() == [L.bounded_distance(*p) is not None for p in pairs]
    assert not len(L._near_pairs([]))


def test_keys_are_few_small_and_equal_to_chunks():
    """A line needs about two keys for an edit, each of them 24 bytes and once for equal lines."""
    rng = random.Random(12)
    words = prose(rng, 5000)
    lines = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)]
    text = "\n".join(lines)
    made = list(L._keys(iter([pa.record_batch([pa.array([text, text])], ["text"])]), 8))
    packed = [e for m in made for e in m.column(2).to_pylist()]
    assert not any(w for m in made for w in m.column(1).to_pylist())
    entries = sum(map(len, packed)) / L._SHORT_ENTRY.itemsize
    assert L._SHORT_ENTRY.itemsize == 24 and entries < 2.3 * sum(L.threshold(len(x)) for x in lines)
    assert entries == sum(len(found) for x in lines for _, _, found in L.chunks(x))
    assert all((np.diff(np.frombuffer(e, L._SHORT_ENTRY)["key"].astype(np.int64)) >= 0).all() for e in packed)


def test_entries_of_very_long_lines_and_cut_runs():
    rng = random.Random(13)
    words = prose(rng, 3000)
    line = " ".join(rng.choice(words) for _ in range(15_000))  # places beyond 16 bits
    copy = line.replace(words[7], words[7][::-1])
    batches = [pa.record_batch([pa.array([x])], ["text"]) for x in (line, copy, "a line that nobody else has in here")]
    made = [b for x in batches for b in L._keys(iter([x]), 4)]
    rows = sorted(((b, w, e) for m in made for b, w, e in zip(*(c.to_pylist() for c in m.columns))), key=lambda r: r[0])
    rows = pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())],
                    ["bucket", "wide", "entries"])
    runs = list(L._bucket_runs(iter(rows.to_batches(max_chunksize=1))))
    groups = {tuple(sorted(g["id"])) for m in L._groups(iter(runs), L.BLOCK, 6) for g in [m.to_pydict()]}
    assert any({L.line_id(line), L.line_id(copy)} <= set(g) for g in groups)
    keys = np.array([1, 1, 1, 2, 3, 3, 5, 5, 5, 5], np.int64)
    for size in range(1, 11):
        parts = list(whole_runs(iter(pa.table([keys, keys], ["a", "b"]).to_batches(max_chunksize=size)), 2))
        assert np.concatenate([p[0] for p in parts]).tolist() == keys.tolist()
        assert all(x[0][-1] != y[0][0] for x, y in zip(parts, parts[1:])) and all(len(p[0]) == len(p[1]) > 0 for p in parts)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups cut into blocks by length and id lose no pair, and what lines share by many keys is not many groups."""
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(14)
    words = prose(rng, 400)
    own = [rng.choice(words) for _ in range(40)]
    rows = []
    for k in range(70):
        copy = list(own)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    got = {k: r["removed"] for k, r in by_id(L.dedup_lines(docs(spark, rows))).items()}
    assert got == near_removed(rows) and 10 < sum(map(len, got.values())) < 70


def test_shuffle_files_go_with_their_query(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(key, None) == (before or "false")
