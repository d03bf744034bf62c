import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tallyloom.functions import n_round
from tallyloom.operators import tabulate as T

SCHEMA = "q int, w double"
ROWS = [(1, 1.0), (1, 2.0), (2, 3.0), (95, 4.0), (None, 5.0)]


def test_freq_table_with_missing(spark):
    out = T.freq_table(spark.createDataFrame(ROWS, SCHEMA), "q", ["w"], missing=[95]).collect()
    assert [r["value"] for r in out] == ["1", "2", "Valid Total", "95", "System missing", "Total"]
    by = {r["value"]: r for r in out}
    assert by["1"]["frequency"] == 2 and by["1"]["percentage"] == 40.0
    assert round(by["1"]["valid_percentage"], 6) == round(200 / 3, 6)
    assert by["1"]["w"] == 3.0 and by["1"]["w_pct"] == 20.0 and by["1"]["w_valid_pct"] == 50.0
    assert by["95"]["valid_percentage"] is None and by["95"]["w_valid_pct"] == 0.0
    assert by["Valid Total"]["w"] == 6.0 and by["Valid Total"]["valid_percentage"] == 100.0
    assert by["System missing"]["w"] == 5.0 and by["System missing"]["frequency"] == 1
    assert by["Total"]["w"] == 15.0 and by["Total"]["valid_percentage"] is None


def test_freq_table_without_missing_has_one_total(spark):
    out = T.freq_table(spark.createDataFrame(ROWS[:3], SCHEMA), "q", scale=1.0, sort=2).collect()
    assert [r["value"] for r in out] == ["1", "2", "Total"]
    assert out[-1]["percentage"] == 1.0 and out[-1]["valid_percentage"] == 1.0


def test_negative_missing_code_and_absent_code(spark):
    df = spark.createDataFrame([(-8, 1.0), (3, 1.0)], SCHEMA)
    out = T.freq_table(df, "q", missing=[-8, 99]).collect()
    assert [(r["value"], r["row_kind"]) for r in out] == [
        ("3", "valid"), ("Valid Total", "valid_total"), ("-8", "missing"), ("Total", "total")]


def test_crosstab_nulls_and_null_weight(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (2, None, 3.0), (None, 1, None), (2, 3, 9.0)]
    df = spark.createDataFrame(rows, "a int, b int, w double")
    out = {r["level"]: r for r in T.crosstab(df, "a", "b", "w", colmissing=[3], colpercent=True).collect()}
    assert list(out) == ["1", "2", "99", "a_Total"]
    assert out["1"]["n_2"] == 2.0 and out["2"]["n_99"] == 3.0 and out["99"]["n"] == 0.0
    assert out["99"]["row_pct_1"] is None
    assert out["a_Total"]["n"] == 6.0 and out["1"]["col_pct_1"] == 1.0


def test_net_position_and_value(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
    out = T.crosstab(df, "a", "b", sum_col={"net": [1, 2]})
    assert out.columns[3:7] == ["n_1", "n_2", "n_net", "n_3"]
    row = out.first()
    assert row["n_net"] == 2 and row["n"] == 3


def test_float_levels_truncate_and_text_levels_pass(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, b string")
    assert [r["level"] for r in T.crosstab(df, "a", "b").collect()] == ["1", "2", "a_Total"]
    assert [r["level"] for r in T.crosstab_rolling(df, "b", "a").collect()] == ["x", "y", "b_Total"]


def test_n_round(spark):
    df = spark.createDataFrame([(v,) for v in (2.5, -2.5, 2.4, -2.6)], "x double")
    assert [r[0] for r in df.select(n_round(df.x)).collect()] == [3.0, -2.0, 2.0, -3.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.integers(1, 4))), min_size=1,
                max_size=30))
def test_cells_sum_to_n(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int")
    out = T.crosstab(df, "a", "b").collect()
    counts = [c for c in out[0].asDict() if c.startswith("n_")]
    for r in out:
        assert sum(r[c] for c in counts) == r["n"]
        assert abs(sum(r["row_pct_" + c[2:]] for c in counts) - 1) < 1e-9
    assert out[-1]["n"] == len(rows)
    freq = T.freq_table(df, "b").collect()
    assert sum(r["frequency"] for r in freq if r["row_kind"] in ("valid", "system_missing")) == len(rows)


def test_listed_categories_and_the_others_sum_to_n(spark):
    df = spark.createDataFrame([(k % 2, k % 4) for k in range(40)] + [(0, None)], "g int, c int")
    for rows in (T.crosstab(df, "g", "c", categories=[2, 1], colpercent=True).collect(),
                 T.crosstab_rolling(df, "g", "c", categories=[2, 1]).collect()):
        for r in rows:
            assert r["n_2"] + r["n_1"] + r["n_other"] == r["n"]
            assert abs(r["row_pct_2"] + r["row_pct_1"] + r["row_pct_other"] - 1) < 1e-9


def test_many_categories(spark):
    df = spark.range(6000).selectExpr("id % 2 AS g", "CAST(id % 200 AS INT) AS c")
    rows = T.crosstab(df, "g", "c").collect()
    assert len(rows[0].asDict()) == 4 + 2 * 200 and rows[-1]["n"] == 6000


def test_text_columns_with_numeric_codes(spark):
    df = spark.createDataFrame([("95",), ("a",), (None,)], "c string")
    assert {r["value"]: r["row_kind"] for r in T.freq_table(df, "c", missing=[95, "a"]).collect()}["95"] == "valid"
    assert T.crosstab(df.selectExpr("c", "1 AS g"), "g", "c", colmissing=[95]).first()["n"] == 3


def test_too_many_categories_are_an_error(spark, monkeypatch):
    from tallyloom.operators import tabulate
    monkeypatch.setattr(tabulate, "MAX_CATEGORIES", 3)
    df = spark.range(20).selectExpr("id % 2 AS a", "id % 4 AS b", "id % 3 AS c")
    assert tabulate.crosstab(df, "a", "c").count() == 3
    with pytest.raises(ValueError, match="crosstab_long"):
        tabulate.crosstab(df, "a", "b")
