"""Means, goodness of fit, one-way ANOVA and descriptive summaries."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import drop_missing
from ..functions.numeric import level_label, n_round
from ..functions.pvalues import chi2_sf, f_sf
from ..plans.targets import target_lists, target_table
from .quantiles import quantile_columns

CHI_ROW = "Chi-square result"


def _null(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)


def weighted_mean(df: DataFrame, col: str, weight: str | None = None,
                  missing: Sequence = ()) -> DataFrame:
    """One row ``mean``: plain, or sum(w*x)/sum(w) where each sum skips its own NULLs."""
    kept = drop_missing(df, col, missing)
    x = F.col(f"`{col}`").cast("double")
    if weight is None:
        return kept.agg(F.avg(x).alias("mean"))
    w = F.col(f"`{weight}`").cast("double")
    return kept.agg(F.try_divide(F.sum(x * w), F.sum(w)).alias("mean"))


def weighting_loss(df: DataFrame, weight: str) -> DataFrame:
    """One row ``loss`` = var(w) / mean(w)^2."""
    w = F.col(f"`{weight}`")
    return df.agg(F.try_divide(F.var_samp(w), F.pow(F.avg(w), F.lit(2))).alias("loss"))


def chi_square_table(df: DataFrame, var: str, shares, input_col: Sequence[str] = ()) -> DataFrame:
    """Per category: sums of ``input_col``, row count and the expected count
    ``round(n * share)``, where n counts every row. ``shares``: {category: share} or a frame
    (category, share)."""
    types = {f.name: f.dataType for f in df.schema}
    if isinstance(shares, Mapping):
        shares = target_table(df.sparkSession, [(var, c, s) for c, s in shares.items()])
        shares = shares.select("category", F.col("proportion").alias("share"))
    else:
        shares = shares.select(
            level_label(F.col("category"), shares.schema["category"].dataType).alias("category"),
            F.col("share").cast("double").alias("share"))
    label = level_label(F.col(f"`{var}`"), types[var])
    groups = df.groupBy(label.alias("category")).agg(
        *[F.sum(F.col(f"`{c}`")).alias(c) for c in input_col],
        F.count(F.lit(1)).alias("counts"))
    n = df.agg(F.count(F.lit(1))).scalar()  # reads no column
    expected = n_round(n.cast("double") * F.col("share"))
    return (groups.filter("category IS NOT NULL").join(shares, "category", "left")
            .select("category", *[F.col(f"`{c}`") for c in input_col], "counts",
                    expected.alias("exp")))


def chi_terms(observed: Column, expected: Column) -> Column:
    """One category's share of the statistic; an expected 0 gives infinity, 0/0 gives NaN."""
    o, e = observed.cast("double"), expected.cast("double")
    return (F.when(e != 0, F.try_divide((o - e) * (o - e), e))
            .when(o != 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def gof_chi_square(df: DataFrame, var: str, weight: str, targets) -> DataFrame:
    """Weighted observed against expected counts of one variable, plus a result row.

    Observed is sum(w) and expected is share * rows, both rounded half to even."""
    lists = target_lists(targets)
    if var not in lists:
        raise ValueError(f"no targets for {var!r}")
    aims = target_table(df.sparkSession, [(var, c, p) for c, p in lists[var].items()])
    label = level_label(F.col(f"`{var}`"), df.schema[var].dataType)
    groups = df.groupBy(label.alias("category")).agg(
        F.sum(F.col(f"`{weight}`").cast("double")).alias("w"))
    n = df.agg(F.count(F.lit(1))).scalar()  # reads no column
    table = aims.join(groups, "category", "left").select(
        "variable", "category",
        F.coalesce(F.bround("w").cast("bigint"), F.lit(0).cast("bigint")).alias("observed"),
        F.bround(F.col("proportion") * n).cast("bigint").alias("expected"))
    result = (table.groupBy("variable")
              .agg(F.sum(chi_terms(F.col("observed"), F.col("expected"))).alias("chi2"))
              .withColumn("p_value", chi2_sf("chi2", F.lit(float(len(lists[var]) - 1)))))
    return table.withColumns({"chi2": F.lit(None).cast("double"),
                              "p_value": F.lit(None).cast("double")}).unionByName(
        result.withColumn("category", F.lit(CHI_ROW)), allowMissingColumns=True)


def oneway_anova(df: DataFrame, iv: str, dv: str, iv_missing: Sequence = (),
                 dv_missing: Sequence = ()) -> DataFrame:
    """One-way ANOVA table (rows ``C(iv)`` and ``Residual``) from one aggregation by group."""
    kept = drop_missing(drop_missing(df, iv, iv_missing), dv, dv_missing)
    x = F.col(f"`{dv}`").cast("double")
    groups = kept.groupBy(F.col(f"`{iv}`").alias("g")).agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("m"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("s2"))
    within = F.sum((F.col("n") - 1) * F.col("s2")).alias("ssw")
    # the subquery uses every column of the groups, so that both share one exchange
    grand = groups.agg(F.struct(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("m"),
                                within).alias("t")).scalar()["m"]
    gap = F.col("m") - grand
    sums = groups.agg(F.sum(F.col("n") * gap * gap).alias("ssb"), within,
                      (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
                      (F.sum("n") - F.count(F.lit(1))).cast("double").alias("df2"))
    sums = sums.withColumn("f", F.try_divide(F.try_divide("ssb", "df1"),
                                             F.try_divide("ssw", "df2")))
    sums = sums.withColumn("p", f_sf("f", "df1", "df2"))
    return sums.select(F.inline(F.array(
        F.struct(F.lit(f"C({iv})").alias("source"), F.col("ssb").alias("sum_sq"),
                 F.col("df1").alias("df"), F.col("f").alias("F"), F.col("p").alias("p_value")),
        F.struct(F.lit("Residual").alias("source"), F.col("ssw").alias("sum_sq"),
                 F.col("df2").alias("df"), _null("F"), _null("p_value")))))


def weight_description(df: DataFrame, weight: str) -> DataFrame:
    """One row: n (all rows), max, min, median, mean, variance, sd of a weight."""
    w = F.col(f"`{weight}`").cast("double")
    median = quantile_columns(df, [weight], [0.5])[weight][0]
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(w).alias("max"), F.min(w).alias("min"),
                  median.alias("median"), F.avg(w).alias("mean"),
                  F.var_samp(w).alias("variance"), F.stddev_samp(w).alias("sd"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max, one row each, one column per variable."""
    quartiles = quantile_columns(df, cols, [0.25, 0.5, 0.75])
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    lines = [("count", lambda c: F.count(x[c]).cast("double")), ("mean", lambda c: F.avg(x[c])),
             ("std", lambda c: F.stddev_samp(x[c])), ("min", lambda c: F.min(x[c])),
             *[(name, lambda c, i=i: quartiles[c][i])
               for i, name in enumerate(["25%", "50%", "75%"])],
             ("max", lambda c: F.max(x[c]))]
    return df.agg(F.array(*[F.struct(F.lit(name).alias("statistic"),
                                     *[measure(c).alias(c) for c in cols])
                            for name, measure in lines]).alias("t")).select(F.inline("t"))
