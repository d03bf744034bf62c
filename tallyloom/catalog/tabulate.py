"""Frequency tables and cross-tables."""
from ..operators import tabulate as T
from .base import resp, rounded, table, with_resp

_PARTY = [1, 2, 3, 4, 95, 98, 99]
_OPINION = ["1", "2", "3", "4", "99"]
_ROLLING = """SELECT *, agegp AS agegp2, edugp AS edugpr, CASE WHEN area < 4 THEN 'north' ELSE 'south' END AS arear FROM resp"""


def _rolling_resp(spark, sf):
    return spark.sql(_ROLLING.replace("FROM resp", "FROM {resp}"), resp=resp(spark, sf))


QUERIES = {
    "freq_table": lambda spark, sf: rounded(T.freq_table(
        table(spark, sf, "lineitem"), "l_returnflag", weights=["l_quantity"])),
    "freq_table_missing": lambda spark, sf: rounded(T.freq_table(
        resp(spark, sf), "supporting_party", weights=["wt", "score"], missing=[95, 98], sort=2,
        w_round=True)),
    "freq_table_fraction": lambda spark, sf: rounded(T.freq_table_fraction(
        resp(spark, sf), "edugp", weights=["wt"], sort=3)),
    "freq_table_rounded": lambda spark, sf: rounded(T.freq_table(
        resp(spark, sf), "opinion", weights=["wt"], missing=[4], pct_round=True)),
    "multi_freq": lambda spark, sf: rounded(T.multi_freq(
        resp(spark, sf), ["edugp", "opinion", "agegp"])),
    "col_content": lambda spark, sf: T.col_content(resp(spark, sf), "supporting_party"),
    "value_counts_with_null": lambda spark, sf: T.value_counts_with_null(resp(spark, sf), "edugp"),
    "crosstab": lambda spark, sf: rounded(T.crosstab(
        table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", categories=["F", "O"])),
    "crosstab_categories": lambda spark, sf: rounded(T.crosstab(
        resp(spark, sf), "agegp", "opinion", weight="wt", colpercent=True, categories=[3, 1])),
    "freq_table_text": lambda spark, sf: rounded(T.freq_table(
        table(spark, sf, "customer"), "c_mktsegment", missing=[95, "BUILDING"])),
    "crosstab_weighted": lambda spark, sf: rounded(T.crosstab(
        resp(spark, sf), "edugp", "supporting_party", weight="wt", colmissing=[95],
        colpercent=True)),
    "crosstab_sum_col": lambda spark, sf: rounded(T.crosstab(
        resp(spark, sf), "agegp", "opinion", sum_col={"agree": [1, 2], "against": [3, 4]},
        colpercent=True, categories=_OPINION)),
    "crosstab_multi_sort": lambda spark, sf: rounded(T.crosstab(
        resp(spark, sf), "area", "m01", column_sort="descending_multi")),
    "crosstab_long": lambda spark, sf: rounded(T.crosstab_long(
        resp(spark, sf), ["gender", "edugp"], "opinion", weight="wt")),
    "main_crosstab": lambda spark, sf: rounded(T.main_crosstab(
        resp(spark, sf), "opinion", weight="wt", party_type=0, customer="TPOF",
        optional_variables=["wave"], colpercent=True)),
    "crosstab_rolling": lambda spark, sf: rounded(T.crosstab_rolling(
        resp(spark, sf), "wave", "opinion", weight="wt", calculate="add", calculate_col1=1,
        calculate_col2=2, colmissing=[3], colpercent=True)),
    "main_crosstab_rolling": lambda spark, sf: rounded(T.main_crosstab_rolling(
        _rolling_resp(spark, sf), "opinion", party_type=0, categories=_OPINION)),
}


def _freq_sql(source, col, weights, missing, scale, kind, w_round=False, pct_round=False):
    """``kind``: SQL type of the weight sums."""
    miss = f"{col} IN ({', '.join(map(str, missing))})" if missing else "FALSE"

    def nr(x):
        return f"CASE WHEN {x} - FLOOR({x}) < 0.5 THEN FLOOR({x}) ELSE CEIL({x}) END"

    def rows(label, row_kind, where, group, valid, w_valid):
        out = [f"{label} AS value", f"'{row_kind}' AS row_kind", "COUNT(*) AS frequency",
               f"{scale} * COUNT(*) / (SELECT COUNT(*) FROM src) AS percentage",
               f"{valid} AS valid_percentage"]
        for w in weights:
            out += [f"CAST(COALESCE(SUM({w}), 0) AS DOUBLE) AS {w}",
                    f"{scale} * COALESCE(SUM({w}), 0) / (SELECT SUM({w}) FROM src) AS {w}_pct",
                    f"CAST({w_valid(w)} AS DOUBLE) AS {w}_valid_pct"]
        return f"SELECT {', '.join(out)} FROM src WHERE {where} {group} HAVING COUNT(*) > 0"

    ok = f"({col} IS NOT NULL AND NOT ({miss}))"
    valid_n = f"(SELECT COUNT(*) FROM src WHERE {ok})"
    split = f"({'TRUE' if missing else 'FALSE'} OR EXISTS (SELECT 1 FROM src WHERE {col} IS NULL))"
    full = f"CAST({scale} AS DOUBLE)"
    total_valid = f"CASE WHEN {split} THEN NULL ELSE {full} END"
    parts = [
        rows(f"CAST({col} AS VARCHAR)", "valid", ok, f"GROUP BY {col}",
             f"{scale} * COUNT(*) / {valid_n}",
             lambda w: f"{scale} * COALESCE(SUM({w}), 0) / (SELECT SUM({w}) FROM src WHERE {ok})"),
        rows(f"CAST({col} AS VARCHAR)", "missing", miss, f"GROUP BY {col}", "NULL", lambda w: "0"),
        rows("'Valid Total'", "valid_total", f"{ok} AND {split}", "", full, lambda w: full),
        rows("'System missing'", "system_missing", f"{col} IS NULL", "", "NULL", lambda w: "NULL"),
        rows("'Total'", "total", "TRUE", "", total_valid, lambda w: total_valid)]
    shown = {"value": "value", "row_kind": "row_kind", "frequency": "frequency"}
    for c in ["percentage", "valid_percentage", *[f"{w}_pct" for w in weights]]:
        shown[c] = f"CAST({nr(c)} AS DOUBLE)" if pct_round else f"ROUND({c}, 6)"
    for w in weights:
        shown[w] = f"CAST({nr(w)} AS DOUBLE)" if w_round else f"ROUND({w}, 6)"
        shown[f"{w}_valid_pct"] = f"ROUND({w}_valid_pct, 6)"
    return (f"SELECT {', '.join(f'{e} AS {c}' for c, e in shown.items())} "
            f"FROM ({' UNION ALL '.join(parts)})"), f"src AS (SELECT * FROM {source})"


def _freq(source, *args, **kw):
    body, cte = _freq_sql(source, *args, **kw)
    return with_resp(body, cte)


def _multi_sql(variables):
    values = " UNION ".join(f"SELECT {v} AS value FROM resp" for v in variables)
    cols = []
    for v in variables:
        n = f"(SELECT COUNT(*) FROM resp WHERE {v} = u.value)"
        cols += [f"{n} AS {v}_frequency",
                 f"ROUND(100.0 * {n} / (SELECT COUNT({v}) FROM resp), 6) AS {v}_percentage"]
    return with_resp(f"SELECT CAST(value AS VARCHAR) AS value, {', '.join(cols)} "
                     f"FROM ({values}) u WHERE value IS NOT NULL")


def _xtab_sql(source, variables, column, cats, weight=None, missing=(), nets=None,
              colpercent=False, rolling=None, listed=False):
    """``listed``: the categories are a given list, all others count as ``other``."""
    nets, kind = nets or {}, "DOUBLE" if weight else "BIGINT"
    where = f"WHERE {column} IS NULL OR {column} NOT IN ({', '.join(map(str, missing))})" if missing else ""
    w = f"COALESCE({weight}, 0)" if weight else "1"
    cells = " UNION ALL ".join(
        f"SELECT {i} AS vo, '{v}' AS variable, COALESCE(CAST({v} AS VARCHAR), '99') AS level, "
        f"COALESCE(CAST({column} AS VARCHAR), '99') AS cat, SUM({w}) AS value "
        f"FROM src {where} GROUP BY 3, 4" for i, v in enumerate(variables))
    members = {str(c): [str(c)] for c in cats} | {k: [str(m) for m in ms] for k, ms in nets.items()}

    if listed:
        members["other"] = None

    def n(c):
        if members[c] is None:
            known = ", ".join(f"'{m}'" for m in cats)
            return f"COALESCE(SUM(value) FILTER (WHERE cat NOT IN ({known})), 0)"
        inside = ", ".join(f"'{m}'" for m in members[c])
        return f"COALESCE(SUM(value) FILTER (WHERE cat IN ({inside})), 0)"

    cols = [f"CAST({n(c)} AS {kind}) AS \"n_{c}\"" for c in members]
    pcts = [f"ROUND(CAST(\"n_{c}\" AS DOUBLE) / NULLIF(n, 0), 6) AS \"row_pct_{c}\"" for c in members]
    if colpercent:
        pcts += [f"ROUND(CAST(\"n_{c}\" AS DOUBLE) / NULLIF(MAX(CASE WHEN row_kind = 'total' THEN \"n_{c}\" END) "
                 f"OVER (PARTITION BY variable), 0), 6) AS \"col_pct_{c}\"" for c in members]
    extra = []
    if rolling:
        name, op, c1, c2 = rolling
        extra = [f"ROUND(CAST(\"n_{c1}\" {op} \"n_{c2}\" AS DOUBLE) / n, 6) AS \"{name}\"",
                 "n AS n_copy"]
    wide = (f"SELECT variable, CASE WHEN GROUPING(level) = 1 THEN variable || '_Total' ELSE level END AS level, "
            f"CASE WHEN GROUPING(level) = 1 THEN 'total' ELSE 'level' END AS row_kind, {', '.join(cols)}, "
            f"CAST(SUM(value) AS {kind}) AS n FROM ({cells}) "
            f"GROUP BY GROUPING SETS ((variable, level), (variable))")
    return with_resp(f"SELECT *, {', '.join(pcts + extra)} FROM ({wide})", f"src AS ({source})")


SQL = {
    "freq_table": _freq("lineitem", "l_returnflag", ["l_quantity"], [], 100.0, "DOUBLE"),
    "freq_table_text": _freq("customer", "c_mktsegment", [], ["'BUILDING'"], 100.0, "DOUBLE"),
    "freq_table_missing": _freq("resp", "supporting_party", ["wt", "score"], [95, 98], 100.0,
                                "DOUBLE", w_round=True),
    "freq_table_fraction": _freq("resp", "edugp", ["wt"], [], 1.0, "DOUBLE"),
    "freq_table_rounded": _freq("resp", "opinion", ["wt"], [4], 100.0, "DOUBLE", pct_round=True),
    "multi_freq": _multi_sql(["edugp", "opinion", "agegp"]),
    "col_content": with_resp("SELECT DISTINCT supporting_party FROM resp"),
    "value_counts_with_null": with_resp(
        "SELECT edugp AS value, COUNT(*) AS count FROM resp GROUP BY edugp"),
    "crosstab": _xtab_sql("SELECT * FROM lineitem", ["l_returnflag"], "l_linestatus", ["F", "O"], listed=True),
    "crosstab_categories": _xtab_sql("SELECT * FROM resp", ["agegp"], "opinion", ["3", "1"], "wt", colpercent=True, listed=True),
    "crosstab_weighted": _xtab_sql("SELECT * FROM resp", ["edugp"], "supporting_party",
                                   [c for c in _PARTY if c != 95], "wt", [95], colpercent=True),
    "crosstab_sum_col": _xtab_sql("SELECT * FROM resp", ["agegp"], "opinion", _OPINION,
                                  nets={"agree": [1, 2], "against": [3, 4]}, colpercent=True, listed=True),
    "crosstab_multi_sort": _xtab_sql("SELECT * FROM resp", ["area"], "m01", ["1", "0"]),
    "crosstab_long": with_resp(
        "SELECT variable, level, category, value, ROUND(value / SUM(value) OVER (PARTITION BY variable, level), 6) AS row_pct, "
        "ROUND(value / SUM(value) OVER (PARTITION BY variable, category), 6) AS col_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{v}' AS variable, COALESCE(CAST({v} AS VARCHAR), '99') AS level, "
            "COALESCE(CAST(opinion AS VARCHAR), '99') AS category, SUM(wt) AS value FROM resp GROUP BY 2, 3"
            for v in ("gender", "edugp")) + ")"),
    "main_crosstab": _xtab_sql(
        "SELECT * FROM resp", ["gender", "agegp", "edugp", "area", "supporting_party", "wave"],
        "opinion", _OPINION, "wt", colpercent=True),
    "crosstab_rolling": _xtab_sql("SELECT * FROM resp", ["wave"], "opinion", ["1", "2", "4", "99"],
                                  "wt", [3], colpercent=True, rolling=("add", "+", 1, 2)),
    "main_crosstab_rolling": _xtab_sql(
        _ROLLING, ["gender", "agegp2", "edugp", "edugpr", "area", "arear", "supporting_party"],
        "opinion", _OPINION, rolling=("minus", "-", 1, 2), listed=True),
}
