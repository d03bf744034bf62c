"""Recodes and their diagnostics."""
from pyspark.sql import functions as F

from ..operators import recode as R
from .base import more, with_resp

BV = {"MARITAL": "c2", "PARTLIV": "pl", "WORK": "wk", "SPWORK": "wk", "MAINSTAT": "c2",
      "SPMAINST": "c2", "WRKHRS": "hours", "SPWRKHRS": "hours", "EMPREL": "ci", "SPEMPREL": "ci",
      "WRKSUP": "c1", "SPWRKSUP": "c1", "NSUP": "occ", "TYPORG1": "ci", "TYPORG2": "ci",
      "ISCO08": "occ", "SPISCO08": "occ", "RELIG": "c2", "RELIGGRP": "c2", "ETHN": "c2",
      "VOTE": "ci", "PARTY": "ci", "HHTODD": "c3", "HHCHILDR": "gender", "HOMPOP": "c2",
      "TW_RINC": "lv", "TW_INC": "inc", "BORN": "c1", "OTHER": "c2"}
_PLV = ("CASE WHEN c2 IN (2, 3) OR pl = 1 THEN 1 WHEN pl = 2 THEN 2 WHEN c2 = 5 AND pl = 3 THEN 2 "
        "WHEN pl = 3 THEN 3 WHEN pl = -8 THEN -7 ELSE -90 END")


def _data(spark, sf):
    """``more`` plus an income item with every option."""
    return more(spark, sf).withColumn("inc", (F.col("id") % 37 - 9).cast("int"))


def _q(label, recode, *args, **options):
    """id and the recoded label."""
    return lambda spark, sf: recode(_data(spark, sf), BV, *args, **options).select("id", label)


def _labelled(label, recode, **options):
    return _q(label, recode, label, **options)


def _both(spark, sf):
    df = R.recode_mainstat(_data(spark, sf), BV, "MAINSTAT")
    return R.recode_work(df, BV, "WORK")


QUERIES = {
    "generate_birth_age": lambda spark, sf: R.generate_birth_age(
        _data(spark, sf), col_y="birthy").select("id", "BIRTH", "AGE", "month"),
    "recode_education": lambda spark, sf: R.recode_education(_data(spark, sf), "lv", "c2").select(
        "id", "TW_ISCD_sr", "TW_ISCD_yr", "TW_ISCD"),
    "recode_education_lenient": lambda spark, sf: R.recode_education(
        _data(spark, sf), "lv", "c2", strict=False).select("id", "TW_ISCD_sr", "TW_ISCD_yr", "TW_ISCD"),
    "recode_marital": _q("MARITAL", R.recode_marital),
    "compute_partliv": _q("PARTLIV", R.compute_partliv),
    "compute_partliv_type2": _q("PARTLIV", R.compute_partliv, type=2),
    "ensure_partliv": _q("PARTLIV", R.ensure_partliv),
    "sp_override": lambda spark, sf: R.sp_issues(_data(spark, sf), BV, "SPWORK"),
    "recode_work": _labelled("WORK", R.recode_work),
    "recode_work_spouse": _labelled("SPWORK", R.recode_work),
    "recode_workhrs": _labelled("WRKHRS", R.recode_workhrs),
    "recode_workhrs_spouse": _labelled("SPWRKHRS", R.recode_workhrs, varies_code=-8),
    "recode_emprel": _labelled("EMPREL", R.recode_emprel, item2_alt_col="a2m"),
    "recode_emprel_type2": _labelled("SPEMPREL", R.recode_emprel, type=2, item2_alt_col="a2m"),
    "recode_wrksup": _labelled("WRKSUP", R.recode_wrksup),
    "recode_wrksup_type2": _labelled("SPWRKSUP", R.recode_wrksup, type=2),
    "recode_nsup": _labelled("NSUP", R.recode_nsup),
    "recode_typorg1": _labelled("TYPORG1", R.recode_typorg1),
    "recode_typorg2": _labelled("TYPORG2", R.recode_typorg2),
    "recode_isco08": _labelled("SPISCO08", R.recode_isco08),
    "recode_mainstat": _labelled("SPMAINST", R.recode_mainstat),
    "recode_relig": _labelled("RELIG", R.recode_relig),
    "recode_relig_one_item": _labelled("RELIG", R.recode_relig, buddhism_item=1),
    "recode_religgrp": _labelled("RELIGGRP", R.recode_religgrp),
    "recode_religgrp_one_item": _labelled("RELIGGRP", R.recode_religgrp, buddhism_item=1),
    "recode_ethn": _labelled("ETHN", R.recode_ethn),
    "recode_vote": _labelled("VOTE", R.recode_vote),
    "recode_party": _labelled("PARTY", R.recode_party, num_candidates=4),
    "recode_hhadult": _q("HHADULT", R.recode_hhadult),
    "recode_rinc": _labelled("TW_RINC", R.recode_rinc),
    "recode_inc": _labelled("TW_INC", R.recode_inc),
    "recode_born": _labelled("BORN", R.recode_born),
    "born_names_used": lambda spark, sf: R.born_names_used(_data(spark, sf), BV, "BORN"),
    "recode_region": lambda spark, sf: R.recode_region(_data(spark, sf)).select("id", "TW_REG"),
    "household_design_weight": lambda spark, sf: R.household_design_weight(_data(spark, sf)).select(
        "id", "household_r", "result_txt", F.round("DWEIGHT_HH", 6).alias("DWEIGHT_HH")),
    "unmatched_design_weight": lambda spark, sf: R.unmatched_design_weight(
        R.household_design_weight(_data(spark, sf))),
    "recode_mode": lambda spark, sf: R.recode_mode(_data(spark, sf)).select("id", "MODE"),
    "report_invalid": lambda spark, sf: R.report_invalid(
        R.recode_born(_data(spark, sf), BV, "BORN"), "BORN", ["c1", "kc1", "nowhere"]),
    "report_other_text": lambda spark, sf: R.report_other_text(
        R.recode_relig(_data(spark, sf), BV, "RELIG"), BV, "RELIG", [8, 4]),
    "work_mainstat_conflicts": lambda spark, sf: R.work_mainstat_conflicts(_both(spark, sf), BV),
    "ethn_other_review": lambda spark, sf: R.ethn_other_review(
        R.recode_ethn(_data(spark, sf), BV, "ETHN"), BV, "ETHN"),
}


def _case(label, case, spouse_test=None):
    """id and the value of a CASE; with ``spouse_test`` the spouse rule comes on top."""
    if spouse_test:
        case = (f"CASE WHEN {spouse_test} IS DISTINCT FROM -6 AND plv = 3 THEN -4 ELSE ({case}) END")
    return with_resp(f"SELECT id, {case} AS \"{label}\" FROM d",
                     f"d AS (SELECT *, {_PLV} AS plv, CAST(id % 37 - 9 AS INT) AS inc FROM more)")


def _in(col, *pairs, default="-90"):
    """CASE from (result, codes) pairs."""
    return ("CASE " + " ".join(f"WHEN {col} IN ({codes}) THEN {result}" for result, codes in pairs)
            + f" ELSE {default} END")


_WORK = "CASE WHEN wk IN (1, 2, 3) AND c2 = 10 THEN 2 " + _in(
    "wk", (1, "1, 2, 3"), (2, "4, 5"), (3, "6"), (-9, "-7, -8"), (-4, "-6"), default="wk")[5:]
_MAINSTAT = "CASE WHEN wk = -6 THEN -4 " + _in(
    "c2", (1, "1, 2, 3, 4, 5, 8, 14, 15"), (2, 6), (3, 7), (4, 9), (5, 12), (6, 10), (7, 11), (8, 13),
    (9, 16), (-9, "-6, -7, -8"))[5:]
_HOURS = ("CASE WHEN wk IN (4, 5, 6) THEN -4 WHEN hours BETWEEN 96 AND 168 THEN 96 WHEN hours IN (-2, -8) THEN -9 "
          "WHEN hours = -6 THEN -4 {}ELSE hours END")
_EMPREL = ("CASE WHEN ci BETWEEN 5 AND 10 THEN 1 WHEN ci = 2 THEN 2 WHEN ci = 1 AND {} THEN 3 "
           "WHEN ci = 1 AND {} THEN 4 WHEN ci IN (3, 4) THEN 5 WHEN wk IN (6, -6) THEN -4 "
           "WHEN ci IN (-6, -7, -8) THEN -9 ELSE -90 END")
_ORG_TAIL = "WHEN ci = -8 THEN -9 WHEN ci = -7 THEN -8 WHEN wk = 6 THEN -4 ELSE -90 END"
_INCOME = "WHEN {0} BETWEEN 2 AND 21 THEN ({0} - 2) * 10000 + 5000 ELSE -90 END"
_BORN = ("CASE WHEN c1 = 1 THEN 158 WHEN c1 = 2 THEN 156 WHEN c1 = -8 THEN -7 WHEN c1 = -7 THEN -9 "
         "WHEN TRIM(kc1) = '日本' THEN 392 ELSE -90 END")
_RELIG = ("CASE WHEN c2 > 2 AND c2 < 9 THEN c2 - 1 WHEN c2 IN (1, 2) THEN 1 WHEN c2 = 9 THEN 0 "
          "WHEN c2 = 10 THEN 8 WHEN c2 = -8 THEN -7 WHEN c2 = -7 THEN -8 ELSE -90 END")
_ETHN = _in("c2", (1, 1), (2, 2), (3, "3, 8"), (4, 4), (5, "5, 6"), (6, 7), (7, "9, 10"), (-7, -8), (-8, -7))

_EDU_HEAD = ("WHEN lv = 1 THEN 10 WHEN lv = 2 THEN 20 WHEN lv IN (11, 12, 13, 14, 15) THEN 550 WHEN lv = 16 THEN 600 "
             "WHEN lv IN (17, 18) THEN 650 WHEN lv = 20 THEN 740 WHEN lv = 21 THEN 840 WHEN lv = -8 THEN -9 ")
_EDU_STATUS = ("CASE " + _EDU_HEAD
               + "WHEN lv = 3 AND c2 = 2 THEN 30 WHEN lv = 3 AND c2 = 1 THEN 100 "
                 "WHEN lv = 4 AND c2 IN (2, 3) THEN 242 WHEN lv = 4 AND c2 = 1 THEN 243 "
                 "WHEN lv = 5 AND c2 = 2 THEN 252 WHEN lv = 5 AND c2 = 1 THEN 253 "
                 "WHEN lv = 6 AND c2 IN (2, 3) THEN 342 WHEN lv = 6 AND c2 = 1 THEN 343 "
                 "WHEN lv IN (7, 8, 9) AND c2 IN (2, 3) THEN 352 WHEN lv IN (7, 8, 9) AND c2 = 1 THEN 353 "
                 "WHEN lv = 10 AND c2 IN (2, 3) THEN 450 WHEN lv = 10 AND c2 = 1 THEN 453 "
                 "WHEN lv = 19 AND c2 IN (2, 3) THEN 343 WHEN lv = 19 AND c2 = 1 THEN 640 ELSE -90 END")
_EDU_YEARS = ("CASE WHEN y IS NULL THEN -90 " + _EDU_HEAD
              + "WHEN lv = 3 THEN CASE WHEN y < 6 THEN 30 ELSE 100 END "
                "WHEN lv = 4 THEN CASE WHEN y < 9 THEN 242 ELSE 243 END "
                "WHEN lv = 5 THEN CASE WHEN y < 9 THEN 252 ELSE 253 END WHEN lv = 6 THEN {six} "
                "WHEN lv IN (7, 8, 9) THEN CASE WHEN y < 12 THEN 352 ELSE 353 END "
                "WHEN lv = 10 THEN CASE WHEN y < 14 THEN 450 ELSE 453 END "
                "WHEN lv = 19 THEN CASE WHEN y < 16 THEN 343 ELSE 640 END ELSE -90 END")


def _education(six):
    return with_resp(
        "SELECT *, CASE WHEN \"TW_ISCD_sr\" = \"TW_ISCD_yr\" THEN \"TW_ISCD_sr\" ELSE -90 END AS \"TW_ISCD\" FROM "
        f"(SELECT id, {_EDU_STATUS} AS \"TW_ISCD_sr\", {_EDU_YEARS.format(six=six)} AS \"TW_ISCD_yr\" FROM d)",
        "d AS (SELECT *, TRY_CAST(kc2 AS INT) AS y FROM more)")


_REGION = ("CASE WHEN z BETWEEN 200 AND 206 THEN 1 WHEN z BETWEEN 100 AND 116 THEN 2 WHEN z BETWEEN 220 AND 253 THEN 3 "
           "WHEN z BETWEEN 320 AND 338 THEN 4 WHEN z BETWEEN 3001 AND 3003 OR z = 300 THEN 5 "
           "WHEN z BETWEEN 302 AND 315 THEN 6 WHEN z BETWEEN 350 AND 369 THEN 7 WHEN z BETWEEN 400 AND 439 THEN 8 "
           "WHEN z BETWEEN 540 AND 558 THEN 10 WHEN z BETWEEN 500 AND 530 THEN 11 WHEN z BETWEEN 630 AND 655 THEN 12 "
           "WHEN z BETWEEN 6001 AND 6002 OR z = 600 THEN 13 WHEN z BETWEEN 602 AND 625 THEN 14 "
           "WHEN z BETWEEN 700 AND 745 THEN 15 WHEN z BETWEEN 800 AND 852 THEN 17 WHEN z BETWEEN 900 AND 947 THEN 19 "
           "WHEN z BETWEEN 260 AND 290 THEN 20 WHEN z BETWEEN 970 AND 983 THEN 21 WHEN z BETWEEN 950 AND 966 THEN 22 "
           "WHEN z BETWEEN 880 AND 885 THEN 23 ELSE -90 END").replace("z ", "zip ")
_TARGET = """CASE
  WHEN sample_rule NOT BETWEEN 1 AND 8 THEN '未定義' WHEN hh = 1 THEN '唯一合格者' WHEN sample_rule = 1 THEN '最年輕者'
  WHEN sample_rule = 2 THEN CASE WHEN hh < 5 THEN '最年輕者' ELSE '第二年輕者' END
  WHEN sample_rule = 3 THEN CASE WHEN hh < 5 THEN '最年輕者' ELSE '第三年輕者' END
  WHEN sample_rule = 4 THEN CASE WHEN hh = 2 THEN '最年輕者' WHEN hh < 5 THEN '第二年輕者' ELSE '第三年輕者' END
  WHEN sample_rule = 5 THEN CASE WHEN hh = 2 THEN '最年輕者' WHEN hh < 5 THEN '第二年輕者' ELSE '第四年輕者' END
  WHEN sample_rule = 6 THEN CASE hh WHEN 2 THEN '最年長者' WHEN 3 THEN '第二年輕者' WHEN 4 THEN '第三年輕者' ELSE '第四年輕者' END
  WHEN sample_rule = 7 THEN CASE hh WHEN 2 THEN '最年長者' WHEN 3 THEN '第二年輕者' WHEN 4 THEN '第三年輕者'
    WHEN 5 THEN '第四年輕者' ELSE '第五年輕者' END
  ELSE '最年長者' END"""
_WEIGHTS = """(VALUES (1, '唯一合格者', 8), (2, '最年輕者', 5), (2, '最年長者', 3), (3, '最年輕者', 3), (3, '第二年輕者', 3),
  (3, '最年長者', 2), (4, '最年輕者', 3), (4, '第二年輕者', 2), (4, '第三年輕者', 2), (4, '最年長者', 1), (5, '最年輕者', 1),
  (5, '第二年輕者', 1), (5, '第三年輕者', 2), (5, '第四年輕者', 3), (5, '最年長者', 1), (6, '最年輕者', 1), (6, '第二年輕者', 1),
  (6, '第三年輕者', 2), (6, '第四年輕者', 2), (6, '第五年輕者', 1), (6, '最年長者', 1)) AS w(size, asked, n)"""
_HOUSE = (f"h AS (SELECT *, LEAST(household, 6) AS hh FROM more), t AS (SELECT *, {_TARGET} AS result_txt FROM h), "
          f"dw AS (SELECT t.*, CAST(n AS DOUBLE) / 48 AS weight FROM t LEFT JOIN {_WEIGHTS} ON size = hh AND asked = result_txt)")
_MODE = """CASE WHEN za2 IN (1, 2, 3) AND zb4 = 4 AND zb604 = 1 THEN -90
  WHEN za2 IN (2, 3) AND zb4 = 2 AND zb604 = 0 THEN 10 WHEN za2 IN (2, 3) AND zb4 IN (1, 3) AND zb604 = 0 THEN 11
  WHEN za2 IN (2, 3) AND zb4 = 4 AND zb604 = 0 THEN 12 WHEN za2 IN (2, 3) AND zb4 = 2 AND zb604 = 1 THEN 13
  WHEN za2 IN (2, 3) AND zb4 IN (1, 3) AND zb604 = 1 THEN 14 WHEN za2 = 1 AND zb4 IN (1, 3) AND zb604 = 0 THEN 21
  WHEN za2 = 1 AND zb4 = 4 AND zb604 = 0 THEN 22 WHEN za2 = 1 AND zb4 = 2 AND zb604 = 1 THEN 23
  WHEN za2 = 1 AND zb4 IN (1, 3) AND zb604 = 1 THEN 24 WHEN za2 = 4 THEN -90 ELSE 20 END"""

SQL = {
    "generate_birth_age": with_resp(
        "SELECT id, birth AS \"BIRTH\", year - birth + CASE WHEN a2m < month THEN 1 ELSE 0 END AS \"AGE\", month FROM ("
        "SELECT *, CASE WHEN birthy IN (-7, -8) THEN 114 - a2r + 1911 ELSE birthy + 1911 END AS birth, "
        "CAST(SUBSTR(LPAD(CAST(sdt1 AS VARCHAR), 4, '0'), 1, 2) AS INT) AS month FROM more)"),
    "recode_education": _education("342"),
    "recode_education_lenient": _education("CASE WHEN y < 12 THEN 342 ELSE 343 END"),
    "recode_marital": _case("MARITAL", "CASE WHEN c2 IN (2, 3) THEN 1 WHEN c2 IN (1, 4, 5, 6) AND pl IN (1, 2) THEN 2 "
                            "WHEN c2 = 5 THEN 3 WHEN c2 = 4 THEN 4 WHEN c2 = 6 THEN 5 WHEN c2 = 1 THEN 6 "
                            "WHEN c2 = -8 THEN -7 ELSE -90 END"),
    "compute_partliv": _case("PARTLIV", "plv"),
    "compute_partliv_type2": _case("PARTLIV", _in("c2", (1, 2), (2, "3, 5"), (3, "1, 4, 6"))),
    "ensure_partliv": _case("PARTLIV", "plv"),
    "sp_override": with_resp("SELECT id, 'SPWORK' AS label, wk, plv FROM "
                             f"(SELECT *, {_PLV} AS plv FROM more) WHERE wk <> -6 AND plv = 3"),
    "recode_work": _case("WORK", _WORK),
    "recode_work_spouse": _case("SPWORK", _WORK, "wk"),
    "recode_workhrs": _case("WRKHRS", _HOURS.format("")),
    "recode_workhrs_spouse": _case("SPWRKHRS", _HOURS.format("WHEN hours = -7 THEN -8 "), "hours"),
    "recode_emprel": _case("EMPREL", _EMPREL.format("a2m BETWEEN 1 AND 9", "a2m >= 10")),
    "recode_emprel_type2": _case("SPEMPREL", _EMPREL.format("a2m = 1", "a2m > 1"), "wk"),
    "recode_wrksup": _case("WRKSUP", "CASE WHEN c1 > 0 THEN 1 WHEN c1 = 0 THEN 2 WHEN c1 = -6 AND wk <> -6 THEN 2 "
                           "WHEN wk = 6 THEN -4 WHEN c1 IN (-2, -7, -8) THEN -9 ELSE -90 END"),
    "recode_wrksup_type2": _case("SPWRKSUP", "CASE WHEN wk IN (6, -6) THEN -4 WHEN c1 = -6 THEN 2 WHEN c1 = -7 THEN -8 "
                                 "WHEN c1 IN (-2, -8) THEN -9 ELSE c1 END", "wk"),
    "recode_nsup": _case("NSUP", "CASE WHEN occ BETWEEN 1 AND 9994 THEN occ WHEN occ >= 9995 THEN 9995 "
                         "WHEN wk = 6 OR occ = 0 THEN -4 WHEN occ = -6 AND wk <> -6 THEN -4 "
                         "WHEN occ IN (-2, -7, -8) THEN -9 ELSE -90 END"),
    "recode_typorg1": _case("TYPORG1", "CASE WHEN ci IN (1, 2, 3, 4, 5, 6, 9, 10) THEN 1 WHEN ci IN (7, 8) THEN 2 " + _ORG_TAIL),
    "recode_typorg2": _case("TYPORG2", "CASE WHEN ci IN (6, 7) THEN 1 WHEN ci IN (1, 2, 3, 4, 5, 8, 9, 10) THEN 2 " + _ORG_TAIL),
    "recode_isco08": _case("SPISCO08", "CASE WHEN wk IN (6, -6) THEN -4 WHEN occ = -8 THEN -9 WHEN occ = -7 THEN -8 "
                           "WHEN occ > 1500 AND occ < 1599 THEN 3341 WHEN occ IN (111, 112) THEN 110 ELSE occ END", "wk"),
    "recode_mainstat": _case("SPMAINST", _MAINSTAT, "wk"),
    "recode_relig": _case("RELIG", _RELIG),
    "recode_relig_one_item": _case("RELIG", "CASE WHEN c2 > 0 AND c2 < 9 THEN c2 WHEN c2 = 9 THEN 8 WHEN c2 = -8 THEN -7 "
                                   "WHEN c2 = -7 THEN -8 ELSE -90 END"),
    "recode_religgrp": _case("RELIGGRP", _in("c2", (0, 9), (1, 7), (2, 8), (6, 6), (7, "1, 2"), (9, "3, 4, 5"), (10, 10),
                                             (-7, -8), (-9, -7))),
    "recode_religgrp_one_item": _case("RELIGGRP", _in("c2", (0, 8), (1, 6), (2, 7), (6, 5), (7, 1), (9, "2, 3, 4"),
                                                      (-7, -8), (-9, -7))),
    "recode_ethn": _case("ETHN", _ETHN),
    "recode_vote": _case("VOTE", _in("ci", (1, "1, 2, 3, 4, 5"), (2, 6), (-4, "7, 8"), (-7, "-7, -8"))),
    "recode_party": _case("PARTY", _in("ci", ("ci", "1, 2, 3, 4"), (96, 5), (-7, 6), (-4, "7, 8, 9, -7, -8"))),
    "recode_hhadult": _case("HHADULT", "CASE WHEN c2 = -8 THEN -9 WHEN c2 = 1 THEN 1 "
                            "WHEN c2 > 0 AND c3 > 0 AND gender > 0 THEN c2 - c3 - gender ELSE -9 END"),
    "recode_rinc": _case("TW_RINC", _in("lv", (0, 1), (250000, 22), (300000, 23), (-9, -9), (-7, -8), (-8, -7),
                                        default="").replace(" ELSE  END", " ") + _INCOME.format("lv")),
    "recode_inc": _case("TW_INC", _in("inc", (0, 1), (250000, 22), (350000, 23), (450000, 24), (750000, 25), (1000000, 26),
                                      (-9, -9), (-7, -8), (-8, -7), default="").replace(" ELSE  END", " ")
                        + _INCOME.format("inc")),
    "recode_born": _case("BORN", _BORN),
    "born_names_used": with_resp("SELECT DISTINCT TRIM(kc1) AS name FROM more WHERE c1 NOT IN (1, 2, -7, -8) "
                                 "AND TRIM(kc1) = '日本'"),
    "recode_region": _case("TW_REG", _REGION),
    "household_design_weight": with_resp(
        "SELECT id, hh AS household_r, result_txt, ROUND(weight, 6) AS \"DWEIGHT_HH\" FROM dw", _HOUSE),
    "unmatched_design_weight": with_resp(
        "SELECT id, hh AS household_r, sample_rule, result_txt FROM dw WHERE weight IS NULL", _HOUSE),
    "recode_mode": _case("MODE", _MODE),
    "report_invalid": with_resp(f"SELECT id, c1, kc1, {_BORN} AS \"BORN\" FROM more WHERE {_BORN} = -90"),
    "report_other_text": with_resp(f"SELECT id, kc2 FROM more WHERE {_RELIG} IN (8, 4)"),
    "work_mainstat_conflicts": with_resp(
        "SELECT id, c2, kc2, wk, w AS \"WORK\", m AS \"MAINSTAT\", lv FROM "
        f"(SELECT *, {_WORK} AS w, {_MAINSTAT} AS m FROM more) WHERE (w = 2 AND m = 1) OR (w = 1 AND m <> 1)"),
    "ethn_other_review": with_resp(f"SELECT id, c2, kc2, {_ETHN} AS \"ETHN\" FROM more WHERE {_ETHN} = 7 AND c2 <> 9"),
}
