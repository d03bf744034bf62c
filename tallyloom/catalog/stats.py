"""Means, tests and summaries."""
from pyspark.sql import functions as F

from ..operators import stats as S
from .base import resp, rounded, table, with_resp

_SEGMENTS = {"AUTOMOBILE": 0.15, "BUILDING": 0.25, "FURNITURE": 0.2, "HOUSEHOLD": 0.2,
             "MACHINERY": 0.2}
_AGES = {1: 0.15, 2: 0.2, 3: 0.25, 4: 0.2, 5: 0.2}


def _customer(spark, sf):
    return table(spark, sf, "customer").withColumn(
        "w", (F.col("c_custkey") % 7 + 1).cast("double") / 4)


QUERIES = {
    "weighted_mean": lambda spark, sf: rounded(S.weighted_mean(
        resp(spark, sf), "score", weight="wt", missing=[97, 98, 99])),
    "weighted_mean_plain": lambda spark, sf: rounded(S.weighted_mean(
        table(spark, sf, "lineitem"), "l_quantity")),
    "weighting_loss": lambda spark, sf: rounded(S.weighting_loss(resp(spark, sf), "wt")),
    "chi_square_table": lambda spark, sf: S.chi_square_table(
        resp(spark, sf), "agegp", _AGES, ["m01", "m02", "m03"]),
    "gof_chi_square": lambda spark, sf: rounded(S.gof_chi_square(
        _customer(spark, sf), "c_mktsegment", "w",
        [("c_mktsegment", c, p) for c, p in _SEGMENTS.items()])),
    "oneway_anova": lambda spark, sf: rounded(S.oneway_anova(
        table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"), 4),
    "oneway_anova_missing": lambda spark, sf: rounded(S.oneway_anova(
        resp(spark, sf), "opinion", "score", iv_missing=[4], dv_missing=[100]), 4),
    "weight_description": lambda spark, sf: rounded(S.weight_description(resp(spark, sf), "wt")),
    "describe_continuous": lambda spark, sf: rounded(S.describe(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_orderkey"]), 4),
    "describe": lambda spark, sf: rounded(S.describe(
        resp(spark, sf), ["score", "a2y", "a2m", "edugp"])),
}


def _gof_sql():
    shares = " UNION ALL ".join(f"SELECT '{c}' AS category, {p} AS p" for c, p in _SEGMENTS.items())
    lines = (f"SELECT 'c_mktsegment' AS variable, s.category, "
             "CAST(round_even(COALESCE((SELECT SUM(CAST(c_custkey % 7 + 1 AS DOUBLE) / 4) FROM customer "
             "WHERE c_mktsegment = s.category), 0), 0) AS BIGINT) AS observed, "
             "CAST(round_even(CAST(s.p AS DOUBLE) * (SELECT COUNT(*) FROM customer), 0) AS BIGINT) AS expected "
             f"FROM ({shares}) s")
    return (f"WITH l AS ({lines}), x AS (SELECT SUM(CAST((observed - expected) * (observed - expected) AS DOUBLE) "
            "/ expected) AS chi2 FROM l) "
            "SELECT variable, category, observed, expected, CAST(NULL AS DOUBLE) AS chi2, "
            "CAST(NULL AS DOUBLE) AS p_value FROM l UNION ALL "
            "SELECT 'c_mktsegment', 'Chi-square result', NULL, NULL, ROUND(chi2, 6), "
            "ROUND(EXP(-chi2 / 2) * (1 + chi2 / 2), 6) FROM x")


def _anova_sql(source, iv, dv):
    """Three groups: df1 = 2 has a closed form for p."""
    return (f"g AS (SELECT {iv} AS g, COUNT(*) AS n, AVG({dv}) AS m, VAR_SAMP({dv}) AS s2 FROM ({source}) "
            f"WHERE {iv} IS NOT NULL AND {dv} IS NOT NULL GROUP BY {iv}), "
            "t AS (SELECT SUM(n * (m - (SELECT SUM(n * m) / SUM(n) FROM g)) ** 2) AS ssb, SUM((n - 1) * s2) AS ssw, "
            "CAST(COUNT(*) - 1 AS DOUBLE) AS df1, CAST(SUM(n) - COUNT(*) AS DOUBLE) AS df2 FROM g), "
            "f AS (SELECT *, (ssb / df1) / (ssw / df2) AS f FROM t)",
            f"SELECT 'C({iv})' AS source, ROUND(ssb, 4) AS sum_sq, df1 AS df, ROUND(f, 4) AS \"F\", "
            "ROUND((1 + 2 * f / df2) ** (-df2 / 2), 4) AS p_value FROM f UNION ALL "
            "SELECT 'Residual', ROUND(ssw, 4), df2, NULL, NULL FROM f")


def _describe_sql(cols, source="resp", digits=6):
    measures = {"count": "CAST(COUNT({c}) AS DOUBLE)", "mean": "AVG({c})", "std": "STDDEV_SAMP({c})",
                "min": "CAST(MIN({c}) AS DOUBLE)", "25%": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)",
                "50%": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5)",
                "75%": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75)", "max": "CAST(MAX({c}) AS DOUBLE)"}
    return with_resp(" UNION ALL ".join(
        f"SELECT '{name}' AS statistic, "
        + ", ".join(f"ROUND({m.format(c=c)}, {digits}) AS {c}" for c in cols) + f" FROM {source}"
        for name, m in measures.items()))


_anova1, _anova2 = _anova_sql("SELECT * FROM lineitem", "l_returnflag", "l_quantity")
_anova3, _anova4 = _anova_sql("SELECT * FROM resp WHERE opinion <> 4 AND score <> 100",
                              "opinion", "score")

SQL = {
    "weighted_mean": with_resp("SELECT ROUND(SUM(score * wt) / SUM(wt), 6) AS mean FROM resp "
                               "WHERE score NOT IN (97, 98, 99)"),
    "weighted_mean_plain": "SELECT ROUND(AVG(l_quantity), 6) AS mean FROM lineitem",
    "weighting_loss": with_resp("SELECT ROUND(VAR_SAMP(wt) / (AVG(wt) * AVG(wt)), 6) AS loss FROM resp"),
    "chi_square_table": with_resp(
        "SELECT CAST(agegp AS VARCHAR) AS category, CAST(SUM(m01) AS BIGINT) AS m01, "
        "CAST(SUM(m02) AS BIGINT) AS m02, CAST(SUM(m03) AS BIGINT) AS m03, COUNT(*) AS counts, "
        "CASE WHEN x - FLOOR(x) < 0.5 THEN FLOOR(x) ELSE CEIL(x) END AS exp FROM (SELECT *, "
        "(SELECT COUNT(*) FROM resp) * CAST(CASE agegp WHEN 1 THEN 0.15 WHEN 3 THEN 0.25 ELSE 0.2 END AS DOUBLE) AS x "
        "FROM resp) GROUP BY agegp, x"),
    "gof_chi_square": _gof_sql(),
    "oneway_anova": f"WITH {_anova1} {_anova2}",
    "oneway_anova_missing": with_resp(_anova4, _anova3),
    "weight_description": with_resp(
        "SELECT COUNT(*) AS n, MAX(wt) AS max, MIN(wt) AS min, MEDIAN(wt) AS median, ROUND(AVG(wt), 6) AS mean, "
        "ROUND(VAR_SAMP(wt), 6) AS variance, ROUND(STDDEV_SAMP(wt), 6) AS sd FROM resp"),
    "describe_continuous": _describe_sql(["l_extendedprice", "l_quantity", "l_orderkey"], "lineitem", 4),
    "describe": _describe_sql(["score", "a2y", "a2m", "edugp"]),
}
