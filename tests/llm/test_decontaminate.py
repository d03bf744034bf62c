import random

from helpers import F, check_odd, docs

from tallyloom.llm import decontaminate as D


def edit_inside(pattern, text):
    """Least edit distance of the pattern to a part of the text, by the plain table."""
    before = [0] * (len(text) + 1)
    for i, ch in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (ch != c)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(2000):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        assert D.myers(p, D.bit_masks(p), t) == edit_inside(p, t)


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "on", "the", "of", "über"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(k, text(rng.randrange(4, 30)).capitalize() + ".") for k in range(30)] + [(30, "!!!"), (31, None), (32, ""), (0, "Beta gamma")]
    rows = []
    for k in range(150):
        _, item = items[rng.randrange(30)]
        chars = list(item.upper() if k % 3 else item)
        for _ in range(rng.randrange(8)):
            chars[rng.randrange(len(chars))] = rng.choice(["", "x", " ", "yy"])
        rows.append((k, f"{text(rng.randrange(20))} {''.join(chars)}, {text(rng.randrange(20))}"))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, leaks int")
    got = {r["doc_id"]: {(x["item_id"], x["distance"]) for x in r["leaks"]} for r in D.find_leaks(docs(spark, rows), bench).collect()}
    for k, t in rows:
        want = {}
        for i, item in items:
            n = D.normal(item)
            budget = int(len(n) * D.ERROR_RATE)
            whole = budget or f" {n} " in f" {D.normal(t)} "
            if n and whole and (d := edit_inside(n, D.normal(t))) <= budget:
                want[i] = min(d, want.get(i, d))
        assert got[k] == set(want.items()), t


def test_blocks_of_items_agree(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number {k} of the test set") for k in range(40)], "item_id long, text string")
    rows = docs(spark, [(k, f"x item number {k} of the test set y") for k in range(40)])
    whole = {r["doc_id"]: sorted(r["leaks"]) for r in D.find_leaks(rows, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    parts = {r["doc_id"]: sorted(r["leaks"]) for r in D.find_leaks(rows, bench).collect()}
    assert whole == parts and all(any(x["item_id"] == k for x in v) for k, v in parts.items())


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "cat"), (2, "a cat"), (3, "no one")], "item_id long, text string")
    rows = [(1, "we concatenate"), (2, "Cat!"), (3, "bobcat cat"), (4, "a cats"), (5, "cat"), (6, "a cat a cat"), (7, "say no one")]
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in D.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {1: [], 2: [1], 3: [1], 4: [], 5: [1], 6: [1, 2], 7: [3]}


def test_ids_of_items_keep_their_type(spark):
    rows = docs(spark, [(1, "so what is the capital of the country then"), (2, "nothing")])
    for kind, ids in (("string", ["hs-1", "hs-2"]), ("int", [1, 2]), ("date", None)):
        values = [(f"2020-01-0{k}",) for k in (1, 2)] if ids is None else [(x,) for x in ids]
        bench = spark.createDataFrame([(*v, t) for v, t in zip(values, ("what is the capital of the country", "something else"))],
                                      f"item_id {'string' if ids is None else kind}, text string")
        bench = bench.withColumn("item_id", F.col("item_id").cast(kind))
        found = D.find_leaks(rows, bench)
        assert found.schema["leaks"].dataType.elementType["item_id"].dataType.simpleString() == kind
        first = bench.where("text like 'what%'").first()["item_id"]
        assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in found.collect()} == {1: [first], 2: []}


def test_indexes_are_built_once_in_a_worker(monkeypatch):
    """As many blocks as a pass holds, asked for batch after batch."""
    built = []
    real = D.ItemIndex
    monkeypatch.setattr(D, "ItemIndex", lambda items, rate: built.append(1) or real(items, rate))
    held = [D._Block(type("Shared", (), {"value": ((k, f"item {k}"),)})()) for k in range(D.PASS_BLOCKS)]
    for _ in range(50):
        for block in held:
            assert D._index(block, D.ERROR_RATE).find(block.items.value[0][1])
    assert len(built) == D.PASS_BLOCKS


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "same words here")], "item_id long, text string")
    out = check_odd(spark, lambda d: D.find_leaks(d, bench))
    assert sorted([x["item_id"] for x in r["leaks"]] for r in out.collect() if r["doc_id"] in (4, 5)) == [[1], [2], [2]]
    check_odd(spark, lambda d: D.find_leaks(d, bench.limit(0)))
