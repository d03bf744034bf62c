import zlib

from helpers import by_id, check_odd, docs

from tallyloom.llm import toxicity

BASE = "/root/testdata/sf0.1"


def auc(pairs):
    ranked = sorted(pairs)
    positive = [k for k, (_, y) in enumerate(ranked, 1) if y]
    n, m = len(positive), len(ranked) - len(positive)
    return (sum(positive) - n * (n + 1) / 2) / (n * m)


def test_held_out_accuracy(spark):
    texts = spark.read.parquet(f"{BASE}/documents.parquet")
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    model = toxicity.train(texts, labels)
    scored = toxicity.score_toxicity(texts, model).withColumn("held_out", toxicity.held_out(texts["doc_id"]))
    held = scored.where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    assert auc([(r["score"], r["toxic"]) for r in held]) > 0.95
    assert sum(r["predicted"] == r["toxic"] for r in held) > 0.95 * len(held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in held)


def test_held_out_labels_change_nothing(spark):
    rows = [(k, f"some words {'idiot moron' if k % 2 else 'kind people'} number {k}") for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    one, two = (toxicity.train(docs(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (one["weights"] == two["weights"]).all() and (one["ratios"] == two["ratios"]).all()
    got = by_id(toxicity.score_toxicity(docs(spark, [(1, "you idiot moron"), (2, "kind people")]), one))
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0


def test_odd_rows_and_labels(spark):
    for labels in ([], [(1, 1)], [(None, 1), (4, None), (5, 7)], [(2, 0), (3, 1), (3, 1), (4, 0), (77, 1)]):
        model = toxicity.train(docs(spark, [(1, None), (2, ""), (3, "bad bad"), (4, "good")]),
                               spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = check_odd(spark, lambda d: toxicity.score_toxicity(d, model))  # noqa: B023
        assert all(0 <= float(r["score"]) <= 1 for r in out.collect())
