import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lookup as L
from tallyloom.sources import writers


def rows_read(df):
    """What the scan of a collected frame gave to the plan above it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_ranges_of_all_widths(spark):
    rng = random.Random(6)
    edge = 1 << 62
    ranges = [(lo := rng.choice([rng.randrange(-300, 300), rng.randrange(-edge, edge)]), lo + rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 1000, edge // 2, -1]), k)
              for k in range(400)] + [(None, 5, 400), (5, None, 401), (-(1 << 63), (1 << 63) - 1, 402), (0, 0, 403), (0, 0, 404)]
    points = [rng.randrange(-310, 310) for _ in range(300)] + [edge, -edge, (1 << 63) - 1, -(1 << 63), None, 0, 0]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(points)], "n int, code long")
    table = spark.createDataFrame(ranges, "lo long, hi long, owner int")
    out = L.range_lookup(df, "code", table)
    assert out.columns == ["n", "code", "owner"]
    want = []
    for n, p in enumerate(points):
        hits = [k for lo, hi, k in ranges if None not in (p, lo, hi) and lo <= p <= hi]
        want += [(n, p, k) for k in hits or [None]]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert L.range_lookup(df, "code", table.limit(0)).where("owner IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        L.range_lookup(df, "code", table.withColumnRenamed("owner", "n"))


def test_lookups_read_few_row_groups(spark, tmp_path):
    rng = random.Random(1)
    ids = [3 * k for k in range(60_000)]
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, f"card{rng.randrange(10 ** 9)}") for i in ids], "id long, card string").withColumn("body", F.expr("repeat(md5(card), 8)"))
    writers.write_clustered(df, str(tmp_path / "t"), "id", "card", row_group_mb=1)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 60_000
    row = df.where("id = 30000").first()
    hit = L.query(back, 30000, ["card"])
    assert hit.collect()[0][0] == row["card"] and rows_read(hit) <= 60_000 / 5
    assert rows_read(L.query(back, 30001, ["card"])) == 0  # within the bounds of a group, but not in its filter
    by_card = L.query(back, row["card"], ["id"], col="card")
    assert by_card.collect()[0][0] == 30000 and rows_read(by_card) <= 60_000 / 5
