import random
from datetime import datetime, timedelta

from tallyloom.operators import gaps as G

START = datetime(2024, 1, 1)


def test_one_respondent_with_half_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, *range(6), None]), START + timedelta(seconds=rng.randrange(40_000)), k) for k in range(3000)]
    rows += [(7, None, 3000), (9, START, 3001)] + [(7, START, k) for k in range(4000, 4050)]  # times that tie
    df = spark.createDataFrame(rows, "who int, at timestamp, n int")
    out = G.neighbours(df, "who", "at", ["n"])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r["n"]: r["previous"] and r["previous"]["n"] for r in out.collect()}
    kept = sorted((w, t, n) for w, t, n in rows if w is not None and t is not None)
    want = {n: (kept[k - 1][2] if k and kept[k - 1][0] == w else None) for k, (w, _, n) in enumerate(kept)}
    assert got == want and int(parts) > 1
    far = {(r["n"], round(r["minutes"], 6)) for r in G.event_gaps(df, "who", "at", 2, ["n"]).collect()}
    gaps = {(n, round((t - kept[k - 1][1]).total_seconds() / 60, 6)) for k, (w, t, n) in enumerate(kept) if k and kept[k - 1][0] == w}
    assert far == {g for g in gaps if g[1] > 2} and far


def test_the_hot_respondent_is_spread(spark):
    df = spark.range(20_000).selectExpr("CAST(IF(id % 2 = 0, 1, id % 50) AS INT) AS who", "timestamp_seconds(id * 7 % 100003) AS at", "id AS n")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = df.repartitionByRange("who", "at", "n").selectExpr("who", "spark_partition_id() AS p").where("who = 1").groupBy("p").count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 10_000 / 3
        plan = G.neighbours(df, "who", "at", ["n"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert "hashpartitioning(who" in plan and "__part" in plan[plan.index("hashpartitioning(who"):][:60]


def test_no_rows(spark):
    assert G.event_gaps(spark.createDataFrame([], "who int, at timestamp"), "who", "at").count() == 0
