"""Raking, trimming and weight reports."""
from pyspark.sql import functions as F

from ..operators import weighting as W
from .base import resp, rounded, with_resp

TARGETS = [("gender", 1, 0.48), ("gender", 2, 0.52),
           ("agegp", 1, 0.15), ("agegp", 2, 0.2), ("agegp", 3, 0.25), ("agegp", 4, 0.2),
           ("agegp", 5, 0.2),
           ("edugp", 1, 0.3), ("edugp", 2, 0.3), ("edugp", 3, 0.4)]
_FLOAT_TARGETS = [(v, float(c), p) for v, c, p in TARGETS]
_PASSES = 3
_LOW, _HIGH = 0.5, 1.25


def _raked(spark, sf):
    return W.rake(resp(spark, sf), TARGETS, passes=_PASSES, tol=None, weight="wt")


QUERIES = {
    "init_weight": lambda spark, sf: W.init_weight(
        W.init_weight(resp(spark, sf), "wt"), 1, "unit").select("id", "wt0", "unit"),
    "rake_once": lambda spark, sf: rounded(W.rake_once(resp(spark, sf), TARGETS, "wt").select(
        "id", "wt0", "wt1", "wt2", "wt3")),
    "rake": lambda spark, sf: rounded(_raked(spark, sf).select("id", "final_weight")),
    "rake_float_targets": lambda spark, sf: rounded(W.rake(
        resp(spark, sf), _FLOAT_TARGETS, passes=_PASSES, tol=None, weight="wt").select("id", "final_weight")),
    "rake_fit": lambda spark, sf: rounded(W.rake_fit(resp(spark, sf), TARGETS, 1, "wt").drop("p_value")),
    "trim_report": lambda spark, sf: rounded(W.trim_report(resp(spark, sf), "wt", _LOW, _HIGH)),
    "trim_weights": lambda spark, sf: rounded(W.trim_weights(
        resp(spark, sf), "wt", _LOW, _HIGH).select("id", "trimmed")),
    "trim_and_rerake": lambda spark, sf: rounded(W.trim_and_rerake(
        resp(spark, sf), "wt", _LOW, _HIGH, TARGETS, auto_skip_threshold=0.01, passes=_PASSES,
        tol=None).select("id", "trimmed", "trimmed_raked")),
    "weight_tables": lambda spark, sf: tables_shown(W.weight_tables(resp(spark, sf), TARGETS, "wt")),
}


def tables_shown(tables):
    """Without the p-values of one degree of freedom, which SQL has no function for; a test holds them."""
    return rounded(tables.withColumn("p_value", F.when(F.col("variable") != "gender", F.col("p_value"))))


def _rake_ctes(source: str, weight: str, passes: int) -> tuple[str, str, int]:
    """Two CTEs per variable step, over the rows; returns (ctes, last name, steps)."""
    order = list(dict.fromkeys(t[0] for t in TARGETS))
    ctes = [f"s0 AS (SELECT id, gender, agegp, edugp, CAST({weight} AS DOUBLE) AS w0 FROM {source})"]
    k = 0
    for _ in range(passes):
        for v in order:
            k += 1
            shares = " ".join(f"WHEN {c} THEN CAST({p} AS DOUBLE)" for n, c, p in TARGETS if n == v)
            kept = ", ".join(["id", "gender", "agegp", "edugp", *[f"w{i}" for i in range(k)]])
            ctes += [
                f"m{k} AS (SELECT {v} AS c, SUM(w{k-1}) AS s FROM s{k-1} WHERE {v} IS NOT NULL GROUP BY {v})",
                f"s{k} AS (SELECT {kept}, CASE WHEN s > 0 THEN w{k-1} * ((SELECT SUM(w{k-1}) FROM s{k-1}) "
                f"* CASE c {shares} END / s) ELSE w{k-1} END AS w{k} "
                f"FROM s{k-1} LEFT JOIN m{k} ON {v} = c)"]
    return ", ".join(ctes), f"s{k}", k


def _trim_ctes(source: str, weight: str, rounds: int = 12) -> tuple[str, str]:
    ctes = [f"r0 AS (SELECT *, CAST({weight} AS DOUBLE) AS w FROM {source})"]
    clip = f"LEAST(GREATEST(w, {_LOW}), {_HIGH})"
    for k in range(1, rounds + 1):
        ctes.append(
            f"a{k} AS (SELECT MAX(w) AS top, SUM(w - {clip}) AS loss, "
            f"COUNT(*) FILTER (WHERE {clip} < {_HIGH}) AS below FROM r{k-1})")
        ctes.append(
            f"r{k} AS (SELECT r{k-1}.* EXCLUDE (w), CASE WHEN top > {_HIGH} THEN {clip} + CASE WHEN {clip} < {_HIGH} "
            f"AND below > 0 THEN loss / below ELSE 0 END ELSE w END AS w FROM r{k-1} CROSS JOIN a{k})")
    return ", ".join(ctes), f"r{rounds}"


def _rake_sql(passes: int, columns: str) -> str:
    ctes, last, k = _rake_ctes("resp", "wt", passes)
    return with_resp(f"SELECT id, {columns.format(k=k, last=last)} FROM {last}", ctes)


def _rerake_sql() -> str:
    trims, trimmed = _trim_ctes("resp", "wt")
    rakes, last, k = _rake_ctes(f"(SELECT id, gender, agegp, edugp, w AS tw FROM {trimmed})", "tw",
                                _PASSES)
    return with_resp(
        f"SELECT id, ROUND(w0, 6) AS trimmed, ROUND(w{k} * (SELECT COUNT(*) / SUM(w{k}) FROM {last}), 6) "
        f"AS trimmed_raked FROM {last}", f"{trims}, {rakes}")


def _tables_sql() -> str:
    shares = " UNION ALL ".join(f"SELECT '{v}' AS variable, '{c}' AS category, CAST({p} AS DOUBLE) AS share"
                                for v, c, p in TARGETS)
    counts = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, '{v}' AS variable, CAST({v} AS VARCHAR) AS category, CAST({e} AS DOUBLE) AS n "
        f"FROM resp WHERE {v} IS NOT NULL GROUP BY {v}"
        for m, e in (("weighted", "SUM(wt)"), ("unweighted", "COUNT(*)")) for v in ("gender", "agegp", "edugp"))
    return with_resp(
        "SELECT mode, variable, category, n AS count, ROUND(100 * n / valid, 6) AS percent, "
        "ROUND(100 * share, 6) AS pop_percent, CAST(NULL AS DOUBLE) AS chi2, CAST(NULL AS DOUBLE) AS p_value FROM t "
        "UNION ALL SELECT mode, variable, 'Chi-square result', NULL, NULL, NULL, ROUND(x, 6), "
        "ROUND(EXP(-x / 2) * CASE variable WHEN 'agegp' THEN 1 + x / 2 WHEN 'edugp' THEN 1 END, 6) FROM "
        "(SELECT mode, variable, SUM((n - share * valid) ** 2 / (share * valid)) AS x FROM t GROUP BY ALL)",
        f"p AS ({shares}), t AS (SELECT c.*, share, SUM(n) OVER (PARTITION BY mode, c.variable) AS valid "
        f"FROM ({counts}) c JOIN p ON c.variable = p.variable AND c.category = p.category)")


def _fit_sql() -> str:
    ctes, _, k = _rake_ctes("resp", "wt", 1)
    order = list(dict.fromkeys(t[0] for t in TARGETS))
    parts = []
    for step in range(k + 1):
        for v in order:
            shares = " ".join(f"WHEN {c} THEN CAST({p} AS DOUBLE)" for n, c, p in TARGETS if n == v)
            raked = f"'{order[(step - 1) % len(order)]}'" if step else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT CAST({step} AS BIGINT) AS step, {raked} AS raked, '{v}' AS variable, "
                         f"ROUND(SUM((o - t * p) ** 2 / (t * p)), 6) AS chi2 FROM (SELECT SUM(w{step}) AS o, CASE {v} {shares} END AS p, "
                         f"SUM(SUM(w{step})) OVER () AS t FROM s{step} WHERE {v} IS NOT NULL GROUP BY {v})")
    return with_resp(" UNION ALL ".join(parts), ctes)


def _trim_report_sql() -> str:
    ctes, last = _trim_ctes("resp", "wt")
    return with_resp(" UNION ALL ".join(
        f"SELECT '{stage}' AS stage, ROUND(VAR_SAMP(w) / AVG(w) ** 2, 6) AS loss, ROUND(SUM(w), 6) AS sum, ROUND(MIN(w), 6) AS min, "
        f"ROUND(MAX(w), 6) AS max FROM {source}" for stage, source in (("before", "r0"), ("after", last))), ctes)


def _trim_sql() -> str:
    ctes, last = _trim_ctes("resp", "wt")
    return with_resp(f"SELECT id, ROUND(w, 6) AS trimmed FROM {last}", ctes)


SQL = {
    "init_weight": with_resp("SELECT id, wt AS wt0, CAST(1 AS DOUBLE) AS unit FROM resp"),
    "rake_once": _rake_sql(1, "ROUND(w0, 6) AS wt0, ROUND(w1, 6) AS wt1, ROUND(w2, 6) AS wt2, ROUND(w3, 6) AS wt3"),
    "rake": _rake_sql(_PASSES, "ROUND(w{k} * (SELECT COUNT(*) / SUM(w{k}) FROM {last}), 6) AS final_weight"),
    "rake_float_targets": _rake_sql(_PASSES, "ROUND(w{k} * (SELECT COUNT(*) / SUM(w{k}) FROM {last}), 6) AS final_weight"),
    "rake_fit": _fit_sql(),
    "trim_report": _trim_report_sql(),
    "trim_weights": _trim_sql(),
    "trim_and_rerake": _rerake_sql(),
    "weight_tables": _tables_sql(),
}
