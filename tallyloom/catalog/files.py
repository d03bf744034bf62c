"""Codebooks and file round trips. Files go to a new folder under the shared one."""
from pyspark.sql import Window, functions as F

from ..functions.missing import clean_nan
from ..operators import checks as C
from ..operators import codebook as B
from ..operators import lookup as L
from ..operators import weighting as W
from ..plans.small import run_folder
from ..sources import readers, writers
from . import checks as K
from . import weighting as KW
from .base import resp, table, with_resp

# the syntax of one survey, made of a row of customer
_SYNTAX = """CONCAT(
 'TITLE "survey ', c_custkey, '".\n',
 'VARIABLE LABELS c', c_custkey, ' "', c_name, '"\n  seg "', c_mktsegment, '"\n  late "unused".\n',
 'COMMENT TO c', c_custkey, ': nation ', c_nationkey, '\n  second line\n',
 'VALUE LABELS c', c_custkey, '\n  1 "yes" 2 "', c_mktsegment, '"\n  -8 "refused"\n/seg 1 "one"\n  1 "', c_name, '".\n',
 'MISSING VALUES c', c_custkey, ' (-9 thru -7, ', c_nationkey, ', x).\n',
 'FORMATS c', c_custkey, ' (F', c_nationkey + 1, '.0).\n')"""


def _syntax(spark, sf):
    """The rows are spread before they become texts, as a small table is read by one task however long its texts are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition(parts, "c_custkey").select(
        F.concat(F.lit("s"), "c_custkey", F.lit(".sps")).alias("file"), F.expr(_SYNTAX).alias("text"))


def _flat(book):
    """Maps and arrays as text, so the rows can be compared."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("value_labels")),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return book.withColumns({"value_labels": labels,
                             "missing": F.array_join(F.flatten(F.transform("missing", lambda r: F.sequence(
                                 r["lo"], r["hi"]))).cast("array<string>"), "|")})


def _syntax_files(spark, sf):
    """One file per survey, read back whole; a survey is known by its own variable."""
    path = run_folder(spark, "syntax")
    writers.write_text_files(_syntax(spark, sf), path)
    book = B.codebook(readers.read_syntax_files(spark, path, "*.txt"))
    own = F.max(F.when(F.col("var").rlike("^c[0-9]+$"), F.concat(F.lit("s"), F.substring("var", 2, 20), F.lit(".sps"))))
    return _flat(book.withColumn("file", own.over(Window.partitionBy("file"))))


def _syntax_lines(spark, sf):
    """All surveys in a few long files, read line by line in blocks; what every survey defines alike is left out."""
    path = run_folder(spark, "syntax-lines")
    _syntax(spark, sf).select("text").write.text(path)
    book = B.codebook_of(B.statements_of_lines(readers.read_syntax_lines(spark, path, "*.txt")))
    return _flat(book.where("var NOT IN ('seg', 'late')")).drop("file")


def _open_ranges(spark, sf):
    """Ranges with open ends, half of the files with a low one."""
    syntax = table(spark, sf, "customer").select(F.concat("c_custkey", F.lit(".sps")).alias("file"), F.expr(
        "CONCAT('MISSING VALUES q (', IF(c_custkey % 2 = 0, 'LO thru -', ''), c_nationkey, ', ', c_nationkey + 90, ' THRU HI).')").alias("text"))
    return B.open_ranges(B.codebook(syntax))


def _rules(spark, sf):
    """Columns in another order, one more than asked for; half as CSV, half as JSON."""
    path = run_folder(spark, "rules")
    rules = table(spark, sf, "part").selectExpr(
        "p_name AS remark", "CONCAT('-8@', p_size) AS special_code", "CAST(p_size AS DOUBLE) AS min",
        "CONCAT('v', p_partkey) AS var", "p_retailprice AS max", "p_partkey % 2 AS half")
    rules.filter("half = 0").drop("half").write.option("header", True).csv(f"{path}/csv")
    rules.filter("half = 1").drop("half").write.json(f"{path}/json")
    return (readers.read_rules(spark, {"range": f"{path}/csv"})["range"].unionByName(
        readers.read_rules(spark, {"range": f"{path}/json"}, fmt="json")["range"]))


def _lookup_list(spark, sf):
    path = run_folder(spark, "pairs")
    (resp(spark, sf).selectExpr("id", "CASE gender WHEN 1 THEN 'cell1' ELSE 'phone1' END AS item")
     .write.option("header", True).csv(path))
    return L.multi_search(resp(spark, sf), readers.read_lookup_list(spark, path))


def _handled_reports(spark, sf):
    """Reports of eight columns of two weeks, one in a folder with a suffix, in CSV and in JSON; one belongs to another handler."""
    root = run_folder(spark, "reports")
    found = K._found(spark, sf).select(
        F.lit("panel").alias("survey"), F.col("id").cast("string").alias("id"),
        F.concat("content", F.lit("\r\r\nsecond line")).alias("content"), "reason", "no", "reply", "wave", "note")
    for week, handler, wanted in (("w00", "lee", "reason LIKE 'score%'"), ("w01_done", "lee_done", "reason LIKE 'c1%'"),
                                  ("w01", "kim", "true")):
        folder = f"{root}/{week[:3]}_檢誤報表{week[3:]}/panel_問卷檢誤_{week[:3]}_20240101_{handler}"
        found.filter(f"id % 2 = 0 AND {wanted}").write.json(f"{folder}.json")
        found.filter(f"id % 2 = 1 AND {wanted}").write.options(header=True, escape='"').csv(f"{folder}.csv")
    nothing = readers.read_handled_reports(spark, root, "other", "lee")
    return nothing.unionByName(readers.read_handled_reports(spark, root, "panel", "lee", fmt="json")).unionByName(
        readers.read_handled_reports(spark, root, "panel", "lee", fmt="csv"))


def _write_findings(spark, sf):
    path = run_folder(spark, "findings")
    found = K._found(spark, sf).withColumn("wave", F.substring("wave", 2, 2))
    for _ in range(2):  # a second run replaces the first
        writers.write_findings(found, path, "panel01")
    return readers.read_findings(spark, path)


def _write_gaps(spark, sf):
    path = run_folder(spark, "gaps")
    writers.write_gap_tables(resp(spark, sf).limit(0), path, "panel01", "02")  # another wave stays apart
    for _ in range(2):
        writers.write_gap_tables(resp(spark, sf), path, "panel01", "01")
    check, data = (spark.read.parquet(f"{path}/{name}").drop("survey_code", "wave") for name in ("ansTime_check", "ansTime_data"))
    return K._flat(check.join(data.select("id", "t2_ansTime"), "id"))


def _write_tables(spark, sf):
    path = run_folder(spark, "weights")
    writers.write_weight_tables(W.weight_tables(resp(spark, sf), KW.TARGETS, "wt"), path)
    return KW.tables_shown(spark.read.parquet(path))


def _write_codebook(spark, sf):
    path = run_folder(spark, "codebook")
    writers.write_codebook(B.codebook(_syntax(spark, sf)), path)
    return _flat(spark.read.parquet(path))


QUERIES = {
    "codebook": lambda spark, sf: _flat(B.codebook(_syntax(spark, sf))),
    "codebook_missing_codes": lambda spark, sf: B.missing_codes(B.codebook(_syntax(spark, sf)), step=2),
    "read_syntax_files": _syntax_files,
    "read_syntax_lines": _syntax_lines,
    "codebook_open_ranges": _open_ranges,
    "read_rules": _rules,
    "read_lookup_list": _lookup_list,
    "read_handled_reports": _handled_reports,
    "write_findings": _write_findings,
    "write_gap_tables": _write_gaps,
    "write_weight_tables": _write_tables,
    "write_codebook": _write_codebook,
    "clean_nan": lambda spark, sf: clean_nan(resp(spark, sf).selectExpr(
        "id", "CASE WHEN area = 1 THEN CAST('NaN' AS DOUBLE) ELSE score END AS score")),
}

_VAR = ("'c' || c_custkey AS var, c_name AS label, 'nation ' || c_nationkey || ' second line' AS comment, "
        "'-8=refused|1=yes|2=' || c_mktsegment AS value_labels, '-9|-8|-7|' || c_nationkey AS missing, "
        "'F' || (c_nationkey + 1) || '.0' AS format")
_BOOK = ("SELECT 's' || c_custkey || '.sps' AS file, " + _VAR + " FROM customer UNION ALL "
         "SELECT 's' || c_custkey || '.sps', 'seg', c_mktsegment, '', '1=' || c_name, '', 'F8.0' FROM customer UNION ALL "
         "SELECT 's' || c_custkey || '.sps', 'late', 'unused', '', '', '', 'F8.0' FROM customer")

SQL = {
    "codebook": _BOOK,
    "codebook_missing_codes": "SELECT 's' || c_custkey || '.sps' AS file, 'c' || c_custkey AS var, "
                              "CAST(UNNEST([-9, -8, -7, c_nationkey]) AS BIGINT) AS code FROM customer",
    "write_codebook": _BOOK,
    "read_syntax_lines": f"SELECT {_VAR} FROM customer",
    "codebook_open_ranges": "SELECT c_custkey || '.sps' AS file, 'q' AS var, NULL AS lo, -c_nationkey AS hi FROM customer WHERE c_custkey % 2 = 0 "
                            "UNION ALL SELECT c_custkey || '.sps', 'q', c_nationkey + 90, NULL FROM customer",
    "read_syntax_files": _BOOK,
    "read_rules": "SELECT 'v' || p_partkey AS var, CAST(p_size AS DOUBLE) AS min, p_retailprice AS max, "
                  "'-8@' || p_size AS special_code FROM part",
    "read_lookup_list": with_resp("SELECT id, CASE gender WHEN 1 THEN 'cell1' ELSE 'phone1' END AS item, "
                                  "CASE gender WHEN 1 THEN cell1 ELSE phone1 END AS value FROM resp"),
    "read_handled_reports": with_resp(
        "SELECT no, CAST(id AS VARCHAR) AS id, content || chr(10) || 'second line' AS content, reason, reply FROM found",
        K._FOUND),
    "write_findings": with_resp("SELECT * REPLACE (SUBSTR(wave, 2, 2) AS wave), 'panel01' AS survey_code "
                                "FROM found", K._FOUND),
    "write_gap_tables": with_resp(f"SELECT g.*, r.t2_ansTime FROM ({K.GAP_BODY}) g "
                                  "JOIN resp r ON r.id = g.id"),
    "write_weight_tables": KW.SQL["weight_tables"],
    "clean_nan": with_resp("SELECT id, CASE WHEN area = 1 THEN NULL ELSE score END AS score FROM resp"),
}
