"""Projections, filters and lookups."""
from pyspark.sql import functions as F

from ..functions import drop_missing, exclude_codes, fill_missing_code, n_round, sum_columns
from ..functions.transcode import transcode_lossy
from ..operators import lookup as L
from ..operators.weighting import select_final_weight
from ..plans.small import run_folder
from ..sources import writers as W
from .base import resp, table, with_resp


def _pairs(spark, sf):
    """One question per respondent; every fourth asks for an item nobody has."""
    return resp(spark, sf).selectExpr(
        "CASE WHEN area = 6 THEN -id ELSE id END AS id",
        "CASE gender + agegp WHEN 2 THEN 'cell1' WHEN 3 THEN 'wt' WHEN 4 THEN 'opinion' "
        "WHEN 5 THEN 'nothing' ELSE 'kc1' END AS item")


def _ranges(spark, sf):
    """As many ranges as orders, of widths from one to thousands, many of them overlapping; one in fifty is the wrong way round."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey * 5 AS lo", "o_orderkey * 5 + CASE WHEN o_orderkey % 50 = 0 THEN -1 WHEN o_orderkey % 997 = 0 THEN 3000 ELSE o_custkey % 9 END AS hi",
        "o_custkey AS owner")


def _in_ranges(spark, sf):
    points = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "IF(l_linenumber = 7, NULL, l_orderkey * 5 + l_linenumber) AS code")
    return L.range_lookup(points, "code", _ranges(spark, sf))


def _clustered(spark, sf):
    """One respondent's answers from a table that was written for that."""
    path = run_folder(spark, "clustered")
    W.write_clustered(resp(spark, sf), path, "id")
    return L.query(spark.read.parquet(path), 1234, ["id", "no", "area", "cell1"])


QUERIES = {
    "range_lookup": _in_ranges,
    "query_clustered": _clustered,
    "n_round": lambda spark, sf: table(spark, sf, "customer").select(
        "c_custkey", n_round(F.col("c_acctbal") / 2).alias("rounded")),
    "query": lambda spark, sf: L.query(resp(spark, sf), 3, ["id", "area"], col="agegp"),
    "sum_columns": lambda spark, sf: sum_columns(
        resp(spark, sf), "m_sum", ["m01", "m02", "m03"]).select("id", "m_sum"),
    "exclude_codes": lambda spark, sf: exclude_codes(
        resp(spark, sf), "supporting_party", [95, 98]).select("id", "supporting_party"),
    "drop_missing": lambda spark, sf: drop_missing(
        resp(spark, sf), "supporting_party", [95, 98]).select("id", "supporting_party"),
    "fill_missing_code": lambda spark, sf: fill_missing_code(
        resp(spark, sf), ["edugp", "opinion"]).select("id", "edugp", "opinion"),
    "select_final_weight": lambda spark, sf: select_final_weight(resp(spark, sf), "wt"),
    "find_literal": lambda spark, sf: L.find_literal(
        table(spark, sf, "documents"), "text", "%", key="doc_id"),
    "multi_search": lambda spark, sf: L.multi_search(resp(spark, sf), _pairs(spark, sf)),
    "multi_search_encoded": lambda spark, sf: L.multi_search(
        resp(spark, sf), _pairs(spark, sf), encoding="ascii"),
    "transcode_lossy": lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", transcode_lossy(F.col("text"), "ascii").alias("text")),
}

_SEARCH = """
SELECT p.id, p.item, CASE p.item WHEN 'cell1' THEN cell1 WHEN 'wt' THEN CAST(wt AS VARCHAR)
       WHEN 'opinion' THEN CAST(opinion AS VARCHAR) WHEN 'kc1' THEN kc1 END AS value
FROM (SELECT CASE WHEN area = 6 THEN -id ELSE id END AS id,
             CASE gender + agegp WHEN 2 THEN 'cell1' WHEN 3 THEN 'wt' WHEN 4 THEN 'opinion'
                  WHEN 5 THEN 'nothing' ELSE 'kc1' END AS item FROM resp) p
LEFT JOIN resp r ON r.id = p.id"""

SQL = {
    "range_lookup": "SELECT l_orderkey, l_linenumber, code, owner FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey * 5 + l_linenumber "
                    "END AS code FROM lineitem) LEFT JOIN (SELECT o_orderkey * 5 AS lo, o_orderkey * 5 + CASE WHEN o_orderkey % 50 = 0 THEN -1 "
                    "WHEN o_orderkey % 997 = 0 THEN 3000 ELSE o_custkey % 9 END AS hi, o_custkey AS owner FROM orders) ON code BETWEEN lo AND hi",
    "query_clustered": with_resp("SELECT id, no, area, cell1 FROM resp WHERE id = 1234"),
    "n_round": "SELECT c_custkey, CASE WHEN c_acctbal / 2 - FLOOR(c_acctbal / 2) < 0.5 THEN FLOOR(c_acctbal / 2) "
               "ELSE CEIL(c_acctbal / 2) END AS rounded FROM customer",
    "query": with_resp("SELECT id, area FROM resp WHERE agegp = 3"),
    "sum_columns": with_resp("SELECT id, CAST(COALESCE(m01,0) + COALESCE(m02,0) + COALESCE(m03,0) "
                             "AS INT) AS m_sum FROM resp"),
    "exclude_codes": with_resp("SELECT id, supporting_party FROM resp WHERE supporting_party IS NULL "
                               "OR supporting_party NOT IN (95, 98)"),
    "drop_missing": with_resp("SELECT id, supporting_party FROM resp "
                              "WHERE supporting_party NOT IN (95, 98)"),
    "fill_missing_code": with_resp("SELECT id, COALESCE(edugp, 99) AS edugp, "
                                   "COALESCE(opinion, 99) AS opinion FROM resp"),
    "select_final_weight": with_resp("SELECT id, wt FROM resp"),
    "find_literal": "SELECT doc_id FROM documents WHERE contains(text, '%')",
    "multi_search": with_resp(_SEARCH),
    "multi_search_encoded": with_resp(
        f"SELECT *, regexp_replace(value, '[^\\x00-\\x7F]', '?', 'g') AS value_ascii FROM ({_SEARCH})"),
    "transcode_lossy": "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text "
                       "FROM documents",
}
