"""Frequency tables and cross-tabulations.

Every table starts from one hash aggregation of the respondent rows (map-side combine, one
exchange). Totals, shares and the wide layout are computed from those aggregated cells only,
so a hot category costs one partial row per task and nothing more.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import exclude_codes, is_in, typed_codes
from ..functions.numeric import is_numeric, level_label, n_round
from ..plans.presets import crosstab_variables, rolling_variables
from ..plans.small import materialize

FILL_CODE = "99"
OTHER = "other"  # the column of the categories that a given list leaves out
_ROW_ORDER = {"valid": 0, "valid_total": 1, "missing": 2, "system_missing": 3, "total": 4}


def _number(c: Column) -> Column:
    return c.try_cast("double")


# --------------------------------------------------------------------------- frequency tables

def freq_table(df: DataFrame, col: str, weights: Sequence[str] = (), w_round: bool = False,
               pct_round: bool = False, missing: Sequence = (), sort: int = 1,
               scale: float = 100.0) -> DataFrame:
    """Frequency table of one variable with shares, summary rows and weighted columns.

    ``sort``: 1 by value, 2 by frequency, 3 by share (both descending). A value is valid when
    it is neither NULL nor listed in ``missing``. Rows come in the order valid values,
    Valid Total, missing codes, System missing, Total; ``row_kind`` names the block.
    """
    counts = df.groupBy(F.col(f"`{col}`").alias("value")).agg(
        F.count(F.lit(1)).alias("frequency"),
        *[F.coalesce(F.sum(F.col(f"`{w}`").cast("double")), F.lit(0.0)).alias(f"w{i}")
          for i, w in enumerate(weights)])
    counts = counts.withColumn(
        "row_kind", F.when(F.col("value").isNull(), "system_missing")
        .when(is_in(F.col("value"), typed_codes(df.schema[col].dataType, missing)), "missing").otherwise("valid"))

    measures = ["frequency"] + [f"w{i}" for i in range(len(weights))]
    valid = F.col("row_kind") == "valid"
    absent = F.col("row_kind") == "system_missing"
    totals = counts.agg(F.struct(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures],
        *[F.coalesce(F.sum(F.when(valid, F.col(m))), F.lit(0)).alias(f"{m}_valid")
          for m in measures],
        *[F.coalesce(F.sum(F.when(absent, F.col(m))), F.lit(0)).alias(f"{m}_absent")
          for m in measures]).alias("t"))

    def share(part: Column, whole: Column) -> Column:
        return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(float(scale))

    t = F.col("t")

    def line(kind: Column, label: Column, key: Column, measure, valid_share: Column,
             weighted_valid_share) -> list[Column]:
        out = [label.alias("value"), kind.alias("row_kind"), key.alias("sort_value"),
               measure("frequency").alias("frequency"),
               share(measure("frequency"), t["frequency"]).alias("percentage"),
               valid_share.alias("valid_percentage")]
        for i, w in enumerate(weights):
            m = f"w{i}"
            out += [measure(m).alias(w), share(measure(m), t[m]).alias(f"{w}_pct"),
                    weighted_valid_share(m).alias(f"{w}_valid_pct")]
        return out

    kind = F.col("row_kind")
    # the totals come as a one-row subquery, which reuses the exchange of the counts
    body = counts.filter(~absent).withColumn("t", totals.scalar()).select(*line(
        kind, F.col("value").cast("string"), F.col("value"), F.col,
        F.when(valid, share(F.col("frequency"), t["frequency_valid"])),
        lambda m: F.when(valid, share(F.col(m), t[f"{m}_valid"])).otherwise(F.lit(0.0))))

    value_type = df.schema[col].dataType
    full, empty = F.lit(float(scale)), F.lit(None).cast("double")
    has_split = F.lit(bool(missing)) | (t["frequency_absent"] > 0)

    def summary(name: str, label: str, suffix: str, valid_share: Column) -> Column:
        return F.struct(*line(F.lit(name), F.lit(label), F.lit(None).cast(value_type),
                              lambda m: t[m + suffix], valid_share, lambda m: valid_share))

    rows = F.array(
        F.when(has_split, summary("valid_total", "Valid Total", "_valid", full)),
        F.when(t["frequency_absent"] > 0,
               summary("system_missing", "System missing", "_absent", empty)),
        summary("total", "Total", "", F.when(has_split, empty).otherwise(full)))
    summaries = totals.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))

    out = body.unionByName(summaries)
    if w_round:
        out = out.withColumns({w: n_round(F.col(f"`{w}`")) for w in weights})
    if pct_round:
        out = out.withColumns({c: n_round(F.col(f"`{c}`")) for c in
                               ["percentage", "valid_percentage", *[f"{w}_pct" for w in weights]]})
    order = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in _ROW_ORDER.items()])
    by = {1: [], 2: [F.desc("frequency")], 3: [F.desc("percentage")]}[sort]
    return out.orderBy(order, *by, "sort_value").drop("sort_value")


def freq_table_fraction(df: DataFrame, col: str, **options) -> DataFrame:
    """:func:`freq_table` on a 0-1 scale."""
    return freq_table(df, col, scale=1.0, **options)


def multi_freq(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Frequency and valid percent of several variables side by side, by value."""
    types = {f.name: f.dataType for f in df.schema}
    long = df.select(*[level_label(F.col(f"`{v}`"), types[v]).alias(v) for v in variables])
    long = long.unpivot([], list(variables), "variable", "value").filter("value IS NOT NULL")
    counts = long.groupBy("variable", "value").count()

    def of(v: str) -> Column:
        return F.sum(F.when(F.col("variable") == v, F.col("count")))

    totals = counts.agg(F.struct(*[of(v).alias(f"v{i}") for i, v in enumerate(variables)])
                        .alias("t")).scalar()
    wide = counts.groupBy("value").agg(*[F.coalesce(of(v), F.lit(0)).alias(f"{v}_frequency")
                                         for v in variables]).withColumn("t", totals)
    columns = [F.col("value")]
    for i, v in enumerate(variables):
        n = F.col(f"`{v}_frequency`")
        columns += [n, F.coalesce(F.try_divide(n.cast("double"), F.col("t")[f"v{i}"]) * 100,
                                  F.lit(0.0)).alias(f"{v}_percentage")]
    return wide.select(*columns).orderBy(_number(F.col("value")), "value")


def col_content(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, NULL included."""
    return df.select(F.col(f"`{col}`")).distinct()


def value_counts_with_null(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(f"`{col}`").alias("value")).agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------------------- cross-tables

def crosstab_cells(df: DataFrame, row_vars: Sequence[str], column: str,
                   weight: str | None = None, colmissing: Sequence = ()) -> DataFrame:
    """(variable, level, category, value) for all row variables in one aggregation.

    Listed codes of ``column`` are dropped, NULL levels and categories become ``99``, a NULL
    weight counts 0.
    """
    types = {f.name: f.dataType for f in df.schema}
    absent = [c for c in [*row_vars, column, *([weight] if weight else [])] if c not in types]
    if absent:
        raise ValueError(f"columns not found: {absent}")

    def label(c: str) -> Column:
        return F.coalesce(level_label(F.col(f"`{c}`"), types[c]), F.lit(FILL_CODE))

    value = (F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight
             else F.lit(1).cast("bigint"))
    narrow = exclude_codes(df, column, colmissing).select(
        *[label(v).alias(v) for v in row_vars],
        label(column).alias("__category"), value.alias("__value"))
    long = narrow.unpivot(["__category", "__value"], list(row_vars), "variable", "level")
    return (long.groupBy("variable", "level", F.col("__category").alias("category"))
            .agg(F.sum("__value").alias("value")))


def crosstab_long(df: DataFrame, row_vars: Sequence[str], column: str,
                  weight: str | None = None, colmissing: Sequence = ()) -> DataFrame:
    """Cells with their row and column shares, one line per cell that occurs."""
    cells = crosstab_cells(df, row_vars, column, weight, colmissing)  # read three times, shuffled once
    rows = cells.groupBy("variable", "level").agg(F.sum("value").alias("row_total"))
    cols = cells.groupBy("variable", "category").agg(F.sum("value").alias("col_total"))
    return (cells.join(rows, ["variable", "level"]).join(cols, ["variable", "category"])
            .select("variable", "level", "category", "value",
                    F.try_divide(F.col("value").cast("double"), F.col("row_total")).alias("row_pct"),
                    F.try_divide(F.col("value").cast("double"), F.col("col_total")).alias("col_pct")))


MAX_CATEGORIES = 5000  # columns that one table can have


def _categories(df: DataFrame, column: str, cells: DataFrame) -> list[str]:
    """Category labels in value order. They become columns, so they are read from the aggregated cells to the plan; a
    table with more categories than a plan can hold is one for ``crosstab_long``."""
    labels = [r[0] for r in cells.select("category").distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(labels) > MAX_CATEGORIES:
        raise ValueError(f"{column!r} has more than {MAX_CATEGORIES} categories: name those wanted, or use crosstab_long")
    return sorted(labels, key=float) if is_numeric(df.schema[column].dataType) else sorted(labels)


def _with_nets(categories: list[str], sum_col: Mapping[str, Sequence]) -> list[str]:
    """Column order: each net stands right after its last member."""
    order = list(categories)
    for name, members in sum_col.items():
        absent = [m for m in members if str(m) not in order]
        if absent:
            raise ValueError(f"net {name!r} refers to unknown categories {absent}")
        order.insert(order.index(str(members[-1])) + 1, name)
    return order


def _wide(cells: DataFrame, row_vars: Sequence[str], categories: list[str],
          sum_col: Mapping[str, Sequence], colpercent: bool) -> tuple[DataFrame, list[str]]:
    """Level rows plus one total row per variable: n_<c>, n, row_pct_<c>, col_pct_<c>."""
    levels = cells.groupBy("variable", "level")
    wide = (levels.pivot("category", categories).agg(F.sum("value")) if categories
            else levels.agg(F.sum("value").alias("n")))
    rows = wide.groupingSets(
        [[F.col("variable"), F.col("level")], [F.col("variable")]], "variable", "level",
    ).agg(*[F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).alias(f"n_{c}") for c in categories],
          *([] if categories else [F.sum("n").alias("n")]), F.grouping("level").alias("is_total"))
    if categories:  # every cell stands in one of the columns
        zero = F.lit(0).cast(rows.schema[f"n_{categories[0]}"].dataType)
        rows = rows.withColumn("n", F.aggregate(F.array(*[F.col(f"`n_{c}`") for c in categories]), zero, lambda a, x: a + x))
    for name, members in sum_col.items():
        net = F.lit(0)
        for m in members:
            net = net + F.col(f"`n_{m}`")
        rows = rows.withColumn(f"n_{name}", net)
    order = _with_nets(categories, sum_col)
    rows = rows.withColumns({f"row_pct_{c}": F.try_divide(F.col(f"`n_{c}`").cast("double"),
                                                          F.col("n").cast("double"))
                             for c in order})
    if colpercent:  # over the finished lines of a variable, its total among them
        lines = Window.partitionBy("variable")
        rows = rows.withColumns({f"col_pct_{c}": F.try_divide(
            F.col(f"`n_{c}`").cast("double"),
            F.max(F.when(F.col("is_total") == 1, F.col(f"`n_{c}`"))).over(lines).cast("double")) for c in order})
    rows = rows.withColumns({
        "row_kind": F.when(F.col("is_total") == 1, "total").otherwise("level"),
        "level": F.when(F.col("is_total") == 1, F.concat("variable", F.lit("_Total")))
        .otherwise(F.col("level"))})
    return rows.orderBy(F.array_position(F.array(*[F.lit(v) for v in row_vars]), F.col("variable")),
                        "is_total", _number(F.col("level")), "level"), order


def _counted(df, row_vars, column, weight, colmissing, categories) -> tuple[DataFrame, list[str]]:
    """Cells and the categories that become columns. With a given list all other categories share the column
    ``other``, so the columns always sum to ``n``."""
    cells = crosstab_cells(df, row_vars, column, weight, colmissing)
    if categories is None:  # the cells are read for the list and for the table: the data itself once
        cells = materialize(cells, "crosstab-cells")
        return cells, _categories(df, column, cells)
    listed = [str(c) for c in categories]
    if OTHER in listed:
        raise ValueError(f"{OTHER!r} names the column of the categories that are not listed")
    category = F.when(F.col("category").isin(listed), F.col("category")).otherwise(OTHER)
    return cells.withColumn("category", category), [*listed, OTHER]


def _stacked_crosstab(df, row_vars, column, weight, colmissing, colpercent, sum_col,
                      column_sort, categories) -> DataFrame:
    cells, cats = _counted(df, row_vars, column, weight, colmissing, categories)
    if column_sort == "descending_multi" and "0" in cats and "1" in cats:
        i, j = cats.index("0"), cats.index("1")
        cats[i], cats[j] = cats[j], cats[i]
    rows, order = _wide(cells, row_vars, cats, sum_col or {}, colpercent)
    names = ["variable", "level", "row_kind", *[f"n_{c}" for c in order],
             *[f"row_pct_{c}" for c in order],
             *([f"col_pct_{c}" for c in order] if colpercent else []), "n"]
    return rows.select(*[F.col(f"`{c}`") for c in names])


def crosstab(df: DataFrame, index: str, column: str, weight: str | None = None,
             colmissing: Sequence = (), colpercent: bool = False,
             sum_col: Mapping[str, Sequence] | None = None, column_sort: str = "ascending",
             categories: Sequence | None = None) -> DataFrame:
    """Cross-tabulate ``index`` by ``column``: cells, total row, N, row (and column) shares.

    ``sum_col`` adds nets such as ``{"agree": [1, 2]}``; ``column_sort="descending_multi"``
    puts the 1 column of a multi-response item before the 0 column. ``categories`` fixes the
    columns and saves the query that looks them up; what it does not list is counted as ``other``.
    """
    return _stacked_crosstab(df, [index], column, weight, colmissing, colpercent, sum_col,
                             column_sort, categories)


def main_crosstab(df: DataFrame, column: str, weight: str | None = None, party_type: int = 1,
                  optional_variables: Sequence[str] = (), colmissing: Sequence = (),
                  colpercent: bool = False, customer: str = "general",
                  categories: Sequence | None = None) -> DataFrame:
    """Cross-tables of a preset list of row variables, stacked, from one aggregation."""
    row_vars = crosstab_variables(customer, party_type) + list(optional_variables)
    return _stacked_crosstab(df, row_vars, column, weight, colmissing, colpercent, None,
                             "ascending", categories)


def _stacked_rolling(df, row_vars, column, weight, calculate, col1, col2, colmissing,
                     colpercent, categories) -> DataFrame:
    cells, cats = _counted(df, row_vars, column, weight, colmissing, categories)
    rows, _ = _wide(cells, row_vars, cats, {}, colpercent)
    score = []
    if calculate is not None:
        a, b = F.col(f"`n_{col1}`"), F.col(f"`n_{col2}`")
        combined = {"add": a + b, "minus": a - b}[calculate]
        score = [F.try_divide(combined.cast("double"), F.col("n").cast("double")).alias(calculate)]
    return rows.select(
        "variable", "level", "row_kind", *[F.col(f"`n_{c}`") for c in cats], "n", *score,
        *[F.col(f"`row_pct_{c}`") for c in cats],
        *([F.col(f"`col_pct_{c}`") for c in cats] if colpercent else []),
        F.col("n").alias("n_copy"))


def crosstab_rolling(df: DataFrame, index: str, column: str, weight: str | None = None,
                     calculate: str | None = None, calculate_col1=None, calculate_col2=None,
                     colmissing: Sequence = (), colpercent: bool = False,
                     categories: Sequence | None = None) -> DataFrame:
    """Cross-table with an optional net score ``(c1 +/- c2) / N``; text levels allowed."""
    return _stacked_rolling(df, [index], column, weight, calculate, calculate_col1,
                            calculate_col2, colmissing, colpercent, categories)


def main_crosstab_rolling(df: DataFrame, column: str, weight: str | None = None,
                          party_type: int = 1, optional_variables: Sequence[str] = (),
                          colmissing: Sequence = (), colpercent: bool = False,
                          categories: Sequence | None = None) -> DataFrame:
    """:func:`crosstab_rolling` with score ``(1 - 2) / N`` for the preset row variables."""
    row_vars = rolling_variables(party_type) + list(optional_variables)
    return _stacked_rolling(df, row_vars, column, weight, "minus", 1, 2, colmissing,
                            colpercent, categories)
