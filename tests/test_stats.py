import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.functions.pvalues import beta_regularised, gamma_upper
from tallyloom.operators import stats as S
from tallyloom.operators import quantiles
from tallyloom.operators.quantiles import exact_quantiles


def test_tail_probabilities():
    for x in (0.1, 1.0, 3.7, 20.0, 80.0):
        assert math.isclose(gamma_upper(1, x / 2), math.exp(-x / 2), rel_tol=1e-10)
        assert math.isclose(gamma_upper(2, x / 2), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-10)
        assert math.isclose(gamma_upper(0.5, x / 2), math.erfc(math.sqrt(x / 2)), rel_tol=1e-9)
        n = 12.0  # F with two numerator degrees of freedom
        assert math.isclose(beta_regularised(n / 2, 1, n / (n + 2 * x)), (1 + 2 * x / n) ** (-n / 2),
                            rel_tol=1e-10)


def test_quantiles_match_numpy(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 5), rng.randint(0, 4) * 1.0) for _ in range(5000)] + [(None, None)]
    rows += [(1.25, 2.0)] * 2500  # one value holds a third of the rows
    df = spark.createDataFrame(rows, "x double, k double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.731, 1.0]
    for limit in (10_000, 50, 3):  # both columns in an aggregate, one, none
        monkeypatch.setattr(quantiles, "FEW", limit)
        got = exact_quantiles(df, ["x", "k"], probs)
        for i, c in enumerate(("x", "k")):
            want = np.quantile([r[i] for r in rows if r[i] is not None], probs)
            assert np.allclose(got[c], want, rtol=1e-12), (limit, c)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert quantiles.spread_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert S.weight_description(df, "x").first()["median"] is None


def test_weighted_mean_skips_nulls_independently(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (None, 5.0), (99.0, 1.0)], "x double, w double")
    assert S.weighted_mean(df, "x", "w", [99]).first()["mean"] == 1.0
    assert S.weighted_mean(df, "x", missing=[99]).first()["mean"] == 2.0


def test_anova_against_formula(spark):
    groups = {"a": [1.0, 2.0, 4.0], "b": [2.0, 5.0], "c": [9.0, 8.0, 7.0, 6.0], "d": [3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("a", None)]
    out = S.oneway_anova(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()
    every = [v for vs in groups.values() for v in vs]
    grand = np.mean(every)
    ssb = sum(len(v) * (np.mean(v) - grand) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert [r["df"] for r in out] == [3.0, 6.0]
    assert np.allclose([r["sum_sq"] for r in out], [ssb, ssw])
    assert np.isclose(out[0]["F"], (ssb / 3) / (ssw / 6)) and 0 < out[0]["p_value"] < 1
    assert out[0]["source"] == "C(g)" and out[1]["F"] is None


def test_gof_absent_category_and_impossible_target(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 1.0), ("b", 1.0)], "v string, w double")
    out = {r["category"]: r for r in S.gof_chi_square(
        df, "v", "w", [("v", "a", 0.5), ("v", "b", 0.5), ("v", "c", 0.0)]).collect()}
    assert out["a"]["observed"] == 2  # 2.5 rounds to even
    assert out["c"]["observed"] == 0 and out["a"]["expected"] == 2
    assert math.isnan(out["Chi-square result"]["chi2"])  # 0/0
    out = S.gof_chi_square(df, "v", "w", [("v", "a", 0.0), ("v", "b", 1.0)]).collect()
    assert out[-1]["chi2"] == math.inf and out[-1]["p_value"] == 0.0


def test_chi_square_table_counts_null_rows_in_n(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (None, 5)], "v int, x int")
    out = {r["category"]: r for r in S.chi_square_table(df, "v", {1: 0.375, 2: 0.5}, ["x"]).collect()}
    assert set(out) == {"1", "2"}
    assert (out["1"]["x"], out["1"]["counts"], out["1"]["exp"]) == (5, 2, 2.0)


def test_describe(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double")
    out = {r["statistic"]: r["x"] for r in S.describe(df, ["x"]).collect()}
    assert out["count"] == 5.0 and out["50%"] == 3.0 and out["25%"] == 2.0 and out["max"] == 5.0
    assert S.weighting_loss(df.filter(F.col("x") < 3), "x").first()["loss"] == 0.5 / 2.25
