import random

import pytest

from tallyloom.operators import checks as C
from tallyloom.operators import handled as H

SCHEMA = "survey string, no string, id string, content string, reason string, reply string, wave string, note string"


def frame(spark, rows):
    return spark.createDataFrame([("s", *r, "", "w", "") for r in rows], SCHEMA)


def rows(rng, n):
    cell = lambda: rng.choice([None, "", "a", "b", "1:a", "a1:", "-"])
    return [(cell(), cell(), cell(), cell()) for _ in range(n)]


def test_as_the_report_over_all_reports(spark, tmp_path):
    rng = random.Random(1)
    found, weeks = frame(spark, rows(rng, 900)), [rows(rng, 200), [], rows(rng, 300)]
    name = H.open_handled(spark, str(tmp_path / "keys"), 4)
    for week in weeks:
        H.add_handled(name, frame(spark, week))
    every = frame(spark, sum(weeks, []))
    again = H.open_handled(spark, str(tmp_path / "keys"), 4)
    for wave in ("00", "05"):
        for copies in (False, True):
            want = C.findings_report(found, every, wave=wave, drop_all_copies=copies).collect()
            for table in (name, again):
                got = H.unhandled(found, table, wave=wave, drop_all_copies=copies)
                assert got.columns == found.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert 0 < len(want) < 900
    with pytest.raises(ValueError, match="buckets"):
        H.open_handled(spark, str(tmp_path / "keys"), 8)


def test_handled_side_stays_where_it_is(spark, tmp_path):
    name = H.open_handled(spark, str(tmp_path / "keys"), 4)
    H.add_handled(name, frame(spark, [("n", "1", "c", "r")]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = H.unhandled(frame(spark, rows(random.Random(2), 50)), name, wave="05")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    handled = plan[plan.index("LeftAnti"):]
    left, right = handled.split("HashAggregate" if "HashAggregate" in handled else "SortAggregate", 1)[0], plan[plan.rindex("FileScan") - 400:]
    assert "Bucketed: true" in plan and "Exchange" not in left and "Exchange" not in right
    assert plan.count("Exchange") == 3  # partial counts, the buckets, the order of the report
