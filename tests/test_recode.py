import pytest

from tallyloom.operators import recode as R

BV = {"MARITAL": "m", "PARTLIV": "p", "WORK": "wk", "SPWORK": "wk", "MAINSTAT": "ms", "SPMAINST": "ms", "X": "x",
      "SPX": "x"}


def run(spark, rows, schema, fn, out, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)
    return [r[out] for r in fn(df, BV, **kw).orderBy("id").collect()]


def one(spark, codes, fn, **kw):
    return run(spark, [(c,) for c in codes], "x int", fn, "X", label="X", **kw)


@pytest.mark.parametrize("fn,kw,codes,want", [
    (R.recode_relig, {"buddhism_item": 1}, [1, 8, 9, 0, -8, -7, None], [1, 8, 8, -90, -7, -8, -90]),
    (R.recode_relig, {}, [1, 2, 3, 8, 9, 10, -8, -7, 11, None], [1, 1, 2, 7, 0, 8, -7, -8, -90, -90]),
    (R.recode_religgrp, {"buddhism_item": 1}, [8, 6, 7, 5, 1, 2, 4, -8, -7, None], [0, 1, 2, 6, 7, 9, 9, -7, -9, -90]),
    (R.recode_religgrp, {}, [9, 7, 8, 6, 2, 3, 10, -8, -7, 0], [0, 1, 2, 6, 7, 9, 10, -7, -9, -90]),
    (R.recode_ethn, {}, [1, 2, 8, 4, 6, 7, 10, -8, -7, None], [1, 2, 3, 4, 5, 6, 7, -7, -8, -90]),
    (R.recode_vote, {"num_candidates": 2}, [1, 2, 4, 5, 6, 7, -7, 8], [1, 1, 1, 2, -4, -4, -7, -90]),
    (R.recode_party, {"num_candidates": 2}, [1, 2, 3, 4, 5, 7, -8, 8], [1, 2, 96, -7, -4, -4, -4, -90]),
    (R.recode_rinc, {}, [1, 2, 21, 22, 23, -9, -8, -7, 24, None], [0, 5000, 195000, 250000, 300000, -9, -7, -8, -90, -90]),
    (R.recode_inc, {}, [1, 2, 21, 24, 26, -9, -8, -7, 27], [0, 5000, 195000, 450000, 1000000, -9, -7, -8, -90]),
])
def test_item_recodes(spark, fn, kw, codes, want):
    assert one(spark, codes, fn, **kw) == want


def test_work_and_spouse_override(spark):
    rows = [(1, 0, 1), (1, 10, 1), (5, 0, 1), (6, 0, 1), (-7, 0, 1), (-6, 0, 3), (9, 0, 1), (None, 0, 3), (1, 0, 3)]
    schema = "wk int, ms int, PARTLIV int"
    assert run(spark, rows, schema, R.recode_work, "WORK", label="WORK") == [1, 2, 2, 3, -9, -4, 9, None, 1]
    assert run(spark, rows, schema, R.recode_work, "SPWORK", label="SPWORK") == [1, 2, 2, 3, -9, -4, 9, -4, -4]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)
    assert sorted(r["id"] for r in R.sp_issues(df, BV, "SPWORK").collect()) == [7, 8]


def test_hours(spark):
    rows = [(96, 1), (168, 1), (169, 1), (-2, 1), (-8, 1), (-7, 1), (-6, 1), (40, 4), (40, 1), (None, 1)]
    args = (spark, [(x, w, 1) for x, w in rows], "x int, wk int, PARTLIV int", R.recode_workhrs, "X")
    assert run(*args, label="X") == [96, 96, 169, -9, -9, -7, -4, -4, 40, None]
    assert run(*args, label="X", varies_code=-8)[5] == -8


def test_emprel(spark):
    rows = [(5, 0, 1), (2, 0, 1), (1, 9, 1), (1, 10, 1), (1, None, 1), (3, 0, 1), (-6, 0, 6), (-7, 0, 1), (11, 0, 1)]
    args = (spark, [(*r, 1) for r in rows], "x int, xa int, wk int, PARTLIV int", R.recode_emprel, "X")
    assert run(*args, label="X") == [1, 2, 3, 4, -90, 5, -4, -9, -90]
    assert run(*args, label="X", type=2)[2:4] == [4, 4]


def test_supervision(spark):
    rows = [(3, 1), (0, 1), (-6, 1), (-6, None), (-6, -6), (-7, 6), (-7, 1), (-3, 1), (9995, 1), (9994, 1), (None, 1)]
    schema = "x int, wk int, PARTLIV int"
    data = [(*r, 1) for r in rows]
    assert run(spark, data, schema, R.recode_wrksup, "X", label="X") == [1, 2, 2, 2, -90, -4, -9, -90, 1, 1, -90]
    assert run(spark, data, schema, R.recode_wrksup, "X", label="X", type=2)[:7] == [3, 0, 2, 2, -4, -4, -8]
    assert run(spark, data, schema, R.recode_nsup, "X", label="X") == [3, -4, -4, -4, -90, -4, -9, -90, 9995, 9994, -90]


def test_organisation_and_occupation(spark):
    rows = [(1, 1), (7, 1), (10, 1), (-8, 1), (-7, 1), (0, 6), (0, 1), (None, 1)]
    args = (spark, [(*r, 1) for r in rows], "x int, wk int, PARTLIV int")
    assert run(*args, R.recode_typorg1, "X", label="X") == [1, 2, 1, -9, -8, -4, -90, -90]
    assert run(*args, R.recode_typorg2, "X", label="X") == [2, 1, 2, -9, -8, -4, -90, -90]
    rows = [(1500, 1), (1501, 1), (1599, 1), (111, 1), (5, -6), (-8, 1), (-7, 1), (None, 1)]
    args = (spark, [(*r, 3) for r in rows], "x int, wk int, PARTLIV int", R.recode_isco08)
    assert run(*args, "X", label="X") == [1500, 3341, 1599, 110, -4, -9, -8, None]
    assert run(*args, "SPX", label="SPX") == [-4, -4, -4, -4, -4, -4, -4, -4]


def test_mainstat_and_partners(spark):
    rows = [(1, 14), (1, 6), (1, 16), (-6, 6), (1, -7), (1, 17), (1, None)]
    assert run(spark, [(*r, 1) for r in rows], "wk int, ms int, PARTLIV int", R.recode_mainstat, "MAINSTAT",
               label="MAINSTAT") == [1, 2, 9, -4, -9, -90, -90]
    rows = [(2, None), (None, 1), (1, 2), (5, 3), (1, 3), (1, -8), (1, None)]
    assert run(spark, rows, "m int, p int", R.compute_partliv, "PARTLIV") == [1, 1, 2, 2, 3, -7, -90]
    assert run(spark, rows, "m int, p int", R.compute_partliv, "PARTLIV", type=2) == [1, -90, 3, 2, 3, 3, 3]
    rows = [(2, 9), (1, 1), (5, 2), (5, 3), (4, 3), (6, None), (1, 3), (-8, 1), (7, 1), (None, 1)]
    assert run(spark, rows, "m int, p int", R.recode_marital, "MARITAL") == [1, 2, 2, 3, 4, 5, 6, -7, -90, -90]


def test_birth_and_age(spark):
    rows = [(70, None, 3, 215, 2025), (70, None, 1, 215, 2025), (-7, 40, 5, 1215, 2025), (None, 40, 5, 1215, 2025)]
    df = spark.createDataFrame(rows, "a2y int, a2r int, a2m int, sdt1 int, year int")
    got = [tuple(r[c] for c in ("BIRTH", "AGE", "month")) for r in R.generate_birth_age(df).collect()]
    assert got == [(1981, 44, 2), (1981, 45, 2), (1985, 41, 12), (None, None, 12)]


def test_education(spark):
    rows = [(1, 9, "0"), (3, 2, "3"), (3, 2, "8"), (6, 1, "12"), (6, 2, "11"), (19, 1, "16"), (16, 1, "x"), (16, 1, "12.0"),
            (-8, 0, "1"), (None, 1, "1"), (12, 1, None), (10, 1, "14")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, b1 int, b2 int, kb2 string")
    got = [r["TW_ISCD"] for r in R.recode_education(df).orderBy("id").collect()]
    assert got == [10, 30, -90, -90, 342, 640, -90, -90, -9, -90, -90, 453]
    assert [r["TW_ISCD"] for r in R.recode_education(df, strict=False).orderBy("id").collect()][3] == 343


def test_household(spark):
    rows = [(1, 4), (2, 6), (3, 4), (7, 7), (5, 2), (0, 4), (0, 6), (3, 9), (None, 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, household int, sample_rule int")
    out = R.household_design_weight(df).orderBy("id")
    assert [(r["result_txt"], r["DWEIGHT_HH"] and round(r["DWEIGHT_HH"] * 48)) for r in out.collect()] == [
        ("唯一合格者", 8), ("最年長者", 3), ("第二年輕者", 3), ("第五年輕者", 1), ("第二年輕者", 1),
        ("第二年輕者", None), ("第四年輕者", None), ("未定義", None), ("最年長者", None)]
    assert sorted(r["id"] for r in R.unmatched_design_weight(out).collect()) == [5, 6, 7, 8]
    kept = df.selectExpr("id", "2 AS household", "1 AS sample_rule", "'最年長者' AS result_txt")
    assert R.household_design_weight(kept).first()["DWEIGHT_HH"] == 3 / 48


def test_born_region_mode_hhadult(spark):
    df = spark.createDataFrame([(1, 1, "日本"), (2, 9, " 日本　"), (3, None, "澳門"), (4, 9, "火星"), (5, -7, None), (6, 9, None)],
                               "id int, x int, kx string")
    out = R.recode_born(df, BV, "X").orderBy("id")
    assert [r["X"] for r in out.collect()] == [158, 392, 158, -90, -9, -90]
    assert sorted(r["name"] for r in R.born_names_used(df, BV, "X").collect()) == ["日本", "澳門"]
    assert [r["id"] for r in R.report_invalid(out, "X", "kx").orderBy("id").collect()] == [4, 6]
    assert [r["id"] for r in R.report_other_text(out, BV, "X", [-90]).collect()] == [4]
    zips = spark.createDataFrame([(206,), (207,), (300,), (3003,), (600,), (885,), (None,)], "zip int")
    assert [r["TW_REG"] for r in R.recode_region(zips).collect()] == [1, -90, 5, 5, 13, 23, -90]
    modes = spark.createDataFrame([(1, 4, 1), (2, 2, 0), (3, 3, 0), (2, 4, 0), (2, 2, 1), (3, 1, 1), (1, 1, 0), (1, 4, 0),
                                   (1, 2, 1), (1, 3, 1), (4, 1, 0), (1, 2, 0), (None, 1, 0)], "za2 int, zb4 int, zb604 int")
    assert [r["MODE"] for r in R.recode_mode(modes).collect()] == [-90, 10, 11, 12, 13, 14, 21, 22, 23, 24, -90, 20, 20]
    hh = spark.createDataFrame([(1, 1, -8), (1, 1, 1), (1, 2, 6), (0, 2, 6), (None, 2, 6)], "t int, y int, h int")
    bv = {"HHTODD": "t", "HHCHILDR": "y", "HOMPOP": "h"}
    assert [r["HHADULT"] for r in R.recode_hhadult(hh, bv).collect()] == [-9, 1, 3, -9, -9]
