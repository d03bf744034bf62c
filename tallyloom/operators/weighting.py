"""Raking (iterative proportional fitting), trimming and weight reports.

A row's raked weight is its starting weight times one factor per variable and step, and the
factor depends on the category only. So the rows are aggregated once to cells (the
combinations of categories that occur), the steps run on the cells, and the factors go back
to the rows as one small lookup per variable: the rows are never shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import level_label
from ..functions.pvalues import chi2_sf
from ..plans.rules import text_literal
from ..plans.small import literal_table, scratch
from ..plans.targets import target_lists, target_table
from .stats import CHI_ROW, chi_terms, weighting_loss

Factors = dict[str, float]


def init_weight(df: DataFrame, weight: str | int = 1, name: str = "wt0") -> DataFrame:
    """Starting weight: 1, or a copy of a column."""
    if weight == 1 and not isinstance(weight, str):
        return df.withColumn(name, F.lit(1.0))
    if isinstance(weight, str) and weight in df.columns:
        return df.withColumn(name, F.col(f"`{weight}`").cast("double"))
    raise ValueError(f"init_weight must be 1 or a column, not {weight!r}")


@dataclass
class _Step:
    variable: str
    factors: Factors


def _label(df: DataFrame, var: str) -> Column:
    return level_label(F.col(f"`{var}`"), df.schema[var].dataType)


def _cells(df: DataFrame, targets: dict[str, dict[str, float]], weight: str) -> DataFrame:
    """Sum of weights per combination of target categories. All codes without a target have the factor 1 and count
    as one, like NULL, so the targets bound the number of cells."""
    labels = [(_label(df, v), list(t)) for v, t in targets.items()]
    return df.groupBy(*[F.when(c.isin(listed), c).alias(f"c{i}") for i, (c, listed) in enumerate(labels)]).agg(
        F.sum(F.col(f"`{weight}`").cast("double")).alias("w"), F.count(F.lit(1)).alias("n"))


def _lookup(col: str, factors: Factors) -> Column:
    """Factor of a category; 1 for a category without one, NULL included."""
    if not factors:
        return F.lit(1.0)
    table = ", ".join(f"{text_literal(c)}, {f!r}D" for c, f in factors.items())
    return F.expr(f"coalesce(try_element_at(map({table}), {col}), 1D)")


def _fit(cells: DataFrame, targets: dict[str, dict[str, float]], passes: int,
         tol: float | None) -> tuple[list[_Step], float]:
    """Steps of the raking and the sum of the weights after the last one.

    Each step reads the cells once and brings back one sum per *target* category; categories
    without a target share a single line, so the driver sees no more than the target list.
    """
    variables = list(targets)
    running: dict[str, Factors] = {v: {} for v in variables}
    steps: list[_Step] = []

    def margins(i: int) -> tuple[dict[str, float], float]:
        w = F.col("w")
        for j, v in enumerate(variables):
            w = w * _lookup(f"c{j}", running[v])
        sums = cells.groupBy(F.col(f"c{i}").alias("c")).agg(F.sum(w).alias("s"), F.sum("n").alias("n")).collect()
        by = {r["c"]: r["s"] for r in sums if r["s"] is not None}
        if sums and not any(r["c"] is not None for r in sums):
            raise ValueError(f"no target category of {variables[i]!r} occurs in the data: {list(targets[variables[i]])}")
        return by, sum(by.values())

    for _ in range(passes):
        moved = 0.0
        for i, v in enumerate(variables):
            sums, total = margins(i)
            factors = {c: total * p / sums[c] for c, p in targets[v].items()
                       if sums.get(c, 0.0) > 0}
            for c, f in factors.items():
                running[v][c] = running[v].get(c, 1.0) * f
                moved = max(moved, abs(f - 1.0))
            steps.append(_Step(v, factors))
        if tol is not None and moved <= tol:
            break
    return steps, margins(0)[1]


def _attach(df: DataFrame, tables: dict[str, dict[str, list[float]]], width: int) -> DataFrame:
    """Add factor columns ``f<i>_<j>`` per variable with one broadcast lookup each. The lookup
    has one line per target category, which the plan knows exactly."""
    for i, (v, lists) in enumerate(tables.items()):
        schema = ", ".join([f"k{i} string", *[f"f{i}_{j} double" for j in range(width)]])
        rows = [(c, *fs) for c, fs in lists.items()]
        small = literal_table(df.sparkSession, rows, schema)
        df = df.join(F.broadcast(small), _label(df, v) == F.col(f"k{i}"), "left").drop(f"k{i}")
    return df


def rake_once(df: DataFrame, targets, weight: str | int = 1) -> DataFrame:
    """One pass over the variables. Adds ``wt0`` and one ``wtK`` per variable step."""
    lists = target_lists(targets)
    start = init_weight(df, weight)
    with scratch(_cells(start, lists, "wt0"), "raking-cells") as cells:
        steps, _ = _fit(cells, lists, 1, None)
    out = _attach(start, {s.variable: {c: [f] for c, f in s.factors.items()} for s in steps}, 1)
    for k in range(len(steps)):
        out = out.withColumn(f"wt{k + 1}", F.col(f"wt{k}") * F.coalesce(f"f{k}_0", F.lit(1.0)))
    return out.drop(*[f"f{k}_0" for k in range(len(steps))])


def rake(df: DataFrame, targets, passes: int = 10, tol: float | None = 1e-9,
         weight: str | int = 1, final_name: str = "final_weight") -> DataFrame:
    """Rake to the targets and scale to sum(w) = number of rows.

    Stops after ``passes`` or when no factor of a pass differs from 1 by more than ``tol``.
    """
    lists = target_lists(targets)
    start = init_weight(df, weight, "__wt0")
    with scratch(_cells(start, lists, "__wt0"), "raking-cells") as cells:
        steps, total = _fit(cells, lists, passes, tol)
        n = cells.agg(F.sum("n")).first()[0]
    product: dict[str, dict[str, list[float]]] = {v: {} for v in lists}
    for s in steps:
        for c, f in s.factors.items():
            product[s.variable].setdefault(c, [1.0])[0] *= f
    out = _attach(start, product, 1)
    w = F.col("__wt0")
    for i in range(len(product)):
        w = w * F.coalesce(f"f{i}_0", F.lit(1.0))
    scale = n / total if total else float("nan")
    return (out.withColumn(final_name, w * F.lit(scale))
            .drop("__wt0", *[f"f{i}_0" for i in range(len(product))]))


# ------------------------------------------------------------------------------- trimming

def _trimmed(w: Column, min_w: float, max_w: float, gains: Sequence[float]) -> Column:
    """The trimming rounds as one fold over the gain of each round."""
    def round_(x: Column, gain: Column) -> Column:
        clipped = F.least(F.greatest(x, F.lit(float(min_w))), F.lit(float(max_w)))
        return clipped + F.when(clipped < F.lit(float(max_w)), gain).otherwise(F.lit(0.0))

    if not gains:
        return w
    folded = F.aggregate(F.array(*[F.lit(float(g)) for g in gains]), w, round_)
    return F.when(w.isNotNull(), folded)


def _trim_gains(df: DataFrame, weight: str, min_w: float, max_w: float) -> list[float]:
    """What every weight below the cap gains in each round, until no weight exceeds it."""
    counts = df.groupBy(F.col(f"`{weight}`").cast("double").alias("w")).agg(
        F.count(F.lit(1)).cast("double").alias("n")).filter("w IS NOT NULL")
    with scratch(counts, "trim-weights") as base:
        return _gains(base, min_w, max_w)


def _gains(base: DataFrame, min_w: float, max_w: float) -> list[float]:
    gains: list[float] = []
    while True:
        state = base.select(_trimmed(F.col("w"), min_w, max_w, gains).alias("w"), "n")
        clipped = F.least(F.greatest(F.col("w"), F.lit(float(min_w))), F.lit(float(max_w)))
        top, loss, below = state.agg(
            F.max("w"), F.sum((F.col("w") - clipped) * F.col("n")),
            F.sum(F.when(clipped < F.lit(float(max_w)), F.col("n")))).first()
        if top is None or top <= max_w:
            return gains
        gains.append(loss / below if below else 0.0)


def trim_weights(df: DataFrame, weight: str, min_w: float, max_w: float,
                 final_name: str = "trimmed") -> DataFrame:
    """While a weight exceeds ``max_w``: clip to [min_w, max_w] and spread what was cut equally
    over the weights below the cap."""
    gains = _trim_gains(df, weight, min_w, max_w)
    return df.withColumn(final_name,
                         _trimmed(F.col(f"`{weight}`").cast("double"), min_w, max_w, gains))


def trim_and_rerake(df: DataFrame, weight: str, min_w: float, max_w: float, targets=None,
                    trimmed_name: str = "trimmed", auto_skip_threshold: float | None = None,
                    passes: int = 10, tol: float | None = 1e-9) -> DataFrame:
    """Trim unless the weighting loss is below the threshold; with ``targets`` rake the trimmed
    weight again into ``<trimmed_name>_raked``."""
    if auto_skip_threshold is not None:
        loss = weighting_loss(df, weight).first()["loss"]
        if loss is not None and loss < auto_skip_threshold:
            return df
    out = trim_weights(df, weight, min_w, max_w, trimmed_name)
    if targets is None:
        return out
    return rake(out, targets, passes, tol, trimmed_name, f"{trimmed_name}_raked")


# ------------------------------------------------------------------------------- reports

def weight_tables(df: DataFrame, targets, weight: str) -> DataFrame:
    """Per mode (weighted, unweighted), variable and category: count, percent, population
    percent; one chi-square row per variable. NULL categories are left out; a category that
    only the data or only the targets know appears with 0 on the other side."""
    lists = target_lists(targets)
    variables = list(lists)
    aims = target_table(df.sparkSession, [(v, c, p) for v, t in lists.items()
                                          for c, p in t.items()])
    narrow = df.select(*[_label(df, v).alias(v) for v in variables],
                       F.col(f"`{weight}`").cast("double").alias("__w"))
    counts = (narrow.unpivot(["__w"], variables, "variable", "category")
              .filter("category IS NOT NULL").groupBy("variable", "category")
              .agg(F.count(F.lit(1)).cast("double").alias("unweighted"),
                   F.coalesce(F.sum("__w"), F.lit(0.0)).alias("weighted")))
    zero = F.lit(0.0)
    both = counts.join(aims, ["variable", "category"], "full").select(
        "variable", "category", F.coalesce("proportion", zero).alias("share"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(m, zero).alias("count"))
                           for m in ("unweighted", "weighted")])))
    # one line per mode and variable: bounded by the target list
    totals = both.groupBy("mode", "variable").agg(
        F.sum("count").alias("valid"), F.count(F.lit(1)).cast("double").alias("k"))
    table = both.join(F.broadcast(totals), ["mode", "variable"])
    lines = table.select("mode", "variable", "category", "count",
                         (F.try_divide("count", "valid") * 100).alias("percent"),
                         (F.col("share") * 100).alias("pop_percent"),
                         F.lit(None).cast("double").alias("chi2"),
                         F.lit(None).cast("double").alias("p_value"))
    result = (table.groupBy("mode", "variable", "k")
              .agg(F.sum(chi_terms(F.col("count"), F.col("share") * F.col("valid"))).alias("chi2"))
              .withColumn("p_value", chi2_sf("chi2", F.col("k") - 1)).drop("k")
              .withColumn("category", F.lit(CHI_ROW)))
    return lines.unionByName(result, allowMissingColumns=True)


def rake_fit(df: DataFrame, targets, passes: int = 1, weight: str | int = 1) -> DataFrame:
    """How well the margins fit after every raking step: ``step`` (0 is the start), ``raked`` (the variable of the step)
    and, for every target variable, ``chi2`` and ``p_value`` of its weighted margin against the targets. Computed from the
    cells of the raking, so the respondents are read once."""
    lists = target_lists(targets)
    with scratch(_cells(init_weight(df, weight, "__wt0"), lists, "__wt0"), "raking-cells") as cells:
        steps, _ = _fit(cells, lists, passes, None)
        running: dict[str, Factors] = {v: {} for v in lists}
        rows = []
        for k, step in enumerate([None, *steps]):
            if step is not None:
                for c, f in step.factors.items():
                    running[step.variable][c] = running[step.variable].get(c, 1.0) * f
            w = F.col("w")
            for j, v in enumerate(lists):
                w = w * _lookup(f"c{j}", running[v])
            sums = cells.agg(*[F.coalesce(F.sum(F.when(F.col(f"c{j}") == c, w)), F.lit(0.0)).alias(f"s{j}_{m}")
                               for j, v in enumerate(lists) for m, c in enumerate(lists[v])]).first()
            for j, (v, shares) in enumerate(lists.items()):
                margin = [sums[f"s{j}_{m}"] for m in range(len(shares))]
                rows += [(k, step.variable if step else None, v, c, s, sum(margin) * p)
                         for (c, p), s in zip(shares.items(), margin)]
    table = literal_table(df.sparkSession, rows, "step long, raked string, variable string, category string, observed double, expected double")
    return (table.groupBy("step", "raked", "variable").agg(
        F.sum(chi_terms(F.col("observed"), F.col("expected"))).alias("chi2"), F.count(F.lit(1)).cast("double").alias("k"))
        .withColumn("p_value", chi2_sf("chi2", F.col("k") - 1)).drop("k"))


def trim_report(df: DataFrame, weight: str, min_w: float, max_w: float) -> DataFrame:
    """The weighting loss, the sum and the extremes of a weight ``before`` and ``after`` trimming."""
    both = trim_weights(df, weight, min_w, max_w, "__after").select(
        F.col(f"`{weight}`").cast("double").alias("before"), F.col("__after").alias("after"))
    stages = both.unpivot([], ["before", "after"], "stage", "w").filter("w IS NOT NULL")
    return stages.groupBy("stage").agg(
        F.try_divide(F.var_samp("w"), F.pow(F.avg("w"), F.lit(2))).alias("loss"), F.sum("w").alias("sum"),
        F.min("w").alias("min"), F.max("w").alias("max"))


def select_final_weight(df: DataFrame, weight: str = "final_weight") -> DataFrame:
    return df.select("id", F.col(f"`{weight}`"))
