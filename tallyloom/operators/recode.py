"""Recodes from national to international survey codes.

Each recode adds one ``CASE WHEN`` column, so any number of them collapses into one
projection without a shuffle. ``bv`` maps a target label to its source column. A value no
rule knows becomes -90; :func:`report_invalid` lists those rows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import is_in, not_equal
from ..functions.numeric import safe_int
from ..functions.text import strip
from ..plans.ordered import UNMAPPED, code_map, first_match
from ..plans import recode_tables as codes
from ..plans.small import literal_table
from ..plans.recode_tables import (COUNTRIES, DESIGN_WEIGHTS, EDUCATION_SIMPLE, EDUCATION_STAGED,
                                   ONLY, REGIONS, SELECTION, UNDEFINED)

Mapping_ = Mapping[str, str]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _optional(df: DataFrame, name: str | None, type_: str) -> Column:
    return _c(name) if name in df.columns else F.lit(None).cast(type_)


def _work_source(bv: Mapping_, label: str) -> str:
    return bv["SPWORK"] if label.startswith("SP") else bv["WORK"]


# ------------------------------------------------------------------------- person and education

def generate_birth_age(df: DataFrame, survey_year: int = 114, col_y: str = "a2y",
                       col_r: str = "a2r", col_m: str = "a2m", col_sdt: str = "sdt1",
                       col_year: str = "year") -> DataFrame:
    """BIRTH (western year), AGE and survey month. Years count from 1911; a refused birth
    year is replaced by the reported age."""
    birth = F.when(_c(col_y).isin(-7, -8), F.lit(survey_year) - _c(col_r) + 1911) \
        .otherwise(_c(col_y) + 1911)
    sdt = _c(col_sdt).cast("bigint")
    padded = F.when(sdt < 0, F.concat(F.lit("-"), F.lpad((-sdt).cast("string"), 3, "0"))) \
        .otherwise(F.lpad(sdt.cast("string"), 4, "0"))
    df = df.withColumn("BIRTH", birth).withColumn(
        "month", F.substring(padded, 1, 2).try_cast("int"))
    age = _c(col_year) - F.col("BIRTH")
    return df.withColumn("AGE", F.when(_c(col_m) < F.col("month"), age + 1).otherwise(age))


def recode_education(df: DataFrame, col_level: str = "b1", col_status: str = "b2",
                     strict: bool = True) -> DataFrame:
    """TW_ISCD from level and completion status (``_sr``) and from level and years of
    schooling (``_yr``); the two must agree.

    With ``strict`` general upper secondary counts as unfinished by years whatever the years;
    ``strict=False`` applies its 12 years.
    """
    level, status = _c(col_level), _c(col_status)
    years = safe_int(_c("k" + col_status))
    by_status = code_map(level, EDUCATION_SIMPLE)
    by_years = [(years.isNull(), UNMAPPED), *code_map(level, EDUCATION_SIMPLE)]
    for levels, full, unfinished, partial, complete in EDUCATION_STAGED:
        at = level.isin(levels)
        by_status += [(at & status.isin(unfinished), partial), (at & (status == 1), complete)]
        short = F.lit(True) if strict and levels == [6] else years < full
        by_years += [(at & short, partial), (at, complete)]
    df = df.withColumns({"TW_ISCD_sr": first_match(by_status), "TW_ISCD_yr": first_match(by_years)})
    agreed = F.col("TW_ISCD_sr") == F.col("TW_ISCD_yr")
    return df.withColumn("TW_ISCD", first_match([(agreed, F.col("TW_ISCD_sr"))]))


def recode_marital(df: DataFrame, bv: Mapping_) -> DataFrame:
    m, p = _c(bv["MARITAL"]), _c(bv["PARTLIV"])
    return df.withColumn("MARITAL", first_match([
        (m.isin(2, 3), 1), (m.isin(1, 4, 5, 6) & p.isin(1, 2), 2),
        (m == 5, 3), (m == 4, 4), (m == 6, 5), (m == 1, 6), (m == -8, -7)]))


def compute_partliv(df: DataFrame, bv: Mapping_, type: int = 1) -> DataFrame:
    """Partner status. Type 1: a partner question was asked; type 2: marital status only."""
    m = _c(bv["MARITAL"])
    if type == 2:
        return df.withColumn("PARTLIV", first_match(code_map(m, {1: [2], 2: [3, 5], 3: [1, 4, 6]})))
    p = _optional(df, bv.get("PARTLIV"), "int")
    return df.withColumn("PARTLIV", first_match([
        (m.isin(2, 3) | (p == 1), 1), (p == 2, 2), ((m == 5) & (p == 3), 2), (p == 3, 3),
        (p == -8, -7)]))


def ensure_partliv(df: DataFrame, bv: Mapping_) -> DataFrame:
    return df if "PARTLIV" in df.columns else compute_partliv(df, bv)


# ------------------------------------------------------------------------- work

def _sp_issue(label: str, tested: Column) -> Column:
    """A spouse answer where there is no spouse: work is not -6 although PARTLIV = 3."""
    if not label.startswith("SP"):
        return F.lit(False)
    return not_equal(tested, -6) & F.coalesce(F.col("PARTLIV") == 3, F.lit(False))


def sp_override(value: Column, label: str, tested: Column) -> Column:
    """-4 for spouse labels without a spouse, else the recoded value."""
    if not label.startswith("SP"):
        return value
    return F.when(_sp_issue(label, tested), F.lit(-4)).otherwise(value)


def sp_issues(df: DataFrame, bv: Mapping_, label: str, tested_col: str | None = None) -> DataFrame:
    """The rows :func:`sp_override` changes: id, label, tested value, PARTLIV. The tested value
    is the spouse's work; for hours pass the hours column."""
    df = ensure_partliv(df, bv)
    tested = _c(tested_col or _work_source(bv, label))
    return df.filter(_sp_issue(label, tested)).select(
        "id", F.lit(label).alias("label"), tested.alias("wk"), F.col("PARTLIV").alias("plv"))


def recode_work(df: DataFrame, bv: Mapping_, label: str = "WORK") -> DataFrame:
    df, item = ensure_partliv(df, bv), _c(bv[label])
    mainstat = _optional(df, bv.get("MAINSTAT" if label == "WORK" else "SPMAINST"), "int")
    value = first_match([(item.isin(1, 2, 3) & (mainstat == 10), 2),
                         *code_map(item, {1: [1, 2, 3], 2: [4, 5], 3: [6], -9: [-7, -8],
                                          -4: [-6]})], item)
    return df.withColumn(label, sp_override(value, label, item))


def recode_workhrs(df: DataFrame, bv: Mapping_, label: str, varies_code: int | None = None) -> DataFrame:
    """Hours, capped at 96. -7 (time varies) passes through unless ``varies_code`` says -8."""
    df, item, wk = ensure_partliv(df, bv), _c(bv[label]), _c(_work_source(bv, label))
    rules = [(wk.isin(4, 5, 6), -4), (item.between(96, 168), 96), (item.isin(-2, -8), -9),
             (item == -6, -4)]
    if varies_code is not None:
        rules.append((item == -7, varies_code))
    return df.withColumn(label, sp_override(first_match(rules, item), label, item))


def recode_emprel(df: DataFrame, bv: Mapping_, label: str = "EMPREL", type: int = 1,
                  item2_alt_col: str | None = None) -> DataFrame:
    """Employment relation; type 2 tells one employee from more than one."""
    df, wk = ensure_partliv(df, bv), _c(_work_source(bv, label))
    i1, i2 = _c(bv[label]), _c(item2_alt_col or bv[label] + "a")
    few, many = (i2.isin(list(range(1, 10))), i2 >= 10) if type == 1 else (i2 == 1, i2 > 1)
    value = first_match([
        (i1.isin(5, 6, 7, 8, 9, 10), 1), (i1 == 2, 2), ((i1 == 1) & few, 3),
        ((i1 == 1) & many, 4), (i1.isin(3, 4), 5), (wk.isin(6, -6), -4), (i1.isin(-6, -7, -8), -9)])
    return df.withColumn(label, sp_override(value, label, wk))


def recode_wrksup(df: DataFrame, bv: Mapping_, label: str = "WRKSUP", type: int = 1) -> DataFrame:
    """Supervises others. Type 1: the item is a head count; type 2: a yes/no item."""
    df, item, wk = ensure_partliv(df, bv), _c(bv[label]), _c(_work_source(bv, label))
    unasked = (item == -6) & not_equal(wk, -6)
    if type == 1:
        value = first_match([(item > 0, 1), (item == 0, 2), (unasked, 2), (wk == 6, -4),
                             (item.isin(-2, -7, -8), -9)])
    else:
        value = first_match([(wk.isin(6, -6), -4), (unasked, 2), (item == -7, -8),
                             (item.isin(-2, -8), -9)], item)
    return df.withColumn(label, sp_override(value, label, wk))


def recode_nsup(df: DataFrame, bv: Mapping_, label: str = "NSUP") -> DataFrame:
    item, wk = _c(bv[label]), _c(bv["WORK"])
    whole = item.between(1, 9994) & (item == F.floor(item))
    return df.withColumn(label, first_match([
        (whole, item), (item >= 9995, 9995), ((wk == 6) | (item == 0), -4),
        ((item == -6) & not_equal(wk, -6), -4), (item.isin(-2, -7, -8), -9)]))


def _organisation(df: DataFrame, bv: Mapping_, label: str, table) -> DataFrame:
    item, wk = _c(bv[label]), _c(bv["WORK"])
    return df.withColumn(label, first_match([
        *code_map(item, table), (item == -8, -9), (item == -7, -8), (wk == 6, -4)]))


def recode_typorg1(df: DataFrame, bv: Mapping_, label: str = "TYPORG1") -> DataFrame:
    """For profit or not."""
    return _organisation(df, bv, label, {1: [1, 2, 3, 4, 5, 6, 9, 10], 2: [7, 8]})


def recode_typorg2(df: DataFrame, bv: Mapping_, label: str = "TYPORG2") -> DataFrame:
    """Public or private."""
    return _organisation(df, bv, label, {1: [6, 7], 2: [1, 2, 3, 4, 5, 8, 9, 10]})


def recode_isco08(df: DataFrame, bv: Mapping_, label: str = "ISCO08") -> DataFrame:
    df, item, wk = ensure_partliv(df, bv), _c(bv[label]), _c(_work_source(bv, label))
    value = first_match([(wk.isin(6, -6), -4), (item == -8, -9), (item == -7, -8),
                         ((item > 1500) & (item < 1599), 3341), (item.isin(111, 112), 110)], item)
    return df.withColumn(label, sp_override(value, label, wk))


def recode_mainstat(df: DataFrame, bv: Mapping_, label: str = "MAINSTAT") -> DataFrame:
    df, item, wk = ensure_partliv(df, bv), _c(bv[label]), _c(_work_source(bv, label))
    value = first_match([(wk == -6, -4), *code_map(item, codes.MAINSTAT)])
    return df.withColumn(label, sp_override(value, label, wk))


# ------------------------------------------------------------------------- religion, ethnicity

def recode_relig(df: DataFrame, bv: Mapping_, label: str, buddhism_item: int = 2) -> DataFrame:
    """Religion; ``buddhism_item`` is the number of Buddhist options in the questionnaire."""
    item = _c(bv[label])
    if buddhism_item == 1:
        rules = [((item > 0) & (item < 9), item), (item == 9, 8)]
    else:
        rules = [((item > 2) & (item < 9), item - 1), (item.isin(1, 2), 1), (item == 9, 0),
                 (item == 10, 8)]
    return df.withColumn(label, first_match([*rules, (item == -8, -7), (item == -7, -8)]))


def recode_religgrp(df: DataFrame, bv: Mapping_, label: str, buddhism_item: int = 2) -> DataFrame:
    item = _c(bv[label])
    table = codes.RELIGION_GROUP_ONE_ITEM if buddhism_item == 1 else codes.RELIGION_GROUP
    return df.withColumn(label, first_match(code_map(item, {**table, -7: [-8], -9: [-7]})))


def recode_ethn(df: DataFrame, bv: Mapping_, label: str) -> DataFrame:
    return df.withColumn(label, first_match(code_map(_c(bv[label]), codes.ETHNIC_GROUP)))


# ------------------------------------------------------------------------- vote, household, income

def recode_vote(df: DataFrame, bv: Mapping_, label: str, num_candidates: int = 3) -> DataFrame:
    n = num_candidates
    return df.withColumn(label, first_match(code_map(_c(bv[label]), {
        1: list(range(1, n + 3)), 2: [n + 3], -4: [n + 4, n + 5], -7: [-7, -8]})))


def recode_party(df: DataFrame, bv: Mapping_, label: str, num_candidates: int = 3) -> DataFrame:
    item, n = _c(bv[label]), num_candidates
    return df.withColumn(label, first_match([
        (item.isin(list(range(1, n + 1))), item),
        *code_map(item, {96: [n + 1], -7: [n + 2], -4: [n + 3, n + 4, n + 5, -7, -8]})]))


def recode_hhadult(df: DataFrame, bv: Mapping_) -> DataFrame:
    child, youth, hh = _c(bv["HHTODD"]), _c(bv["HHCHILDR"]), _c(bv["HOMPOP"])
    return df.withColumn("HHADULT", first_match([
        (hh == -8, -9), (hh == 1, 1),
        ((hh > 0) & (child > 0) & (youth > 0), hh - child - youth)], -9))


def _income(df: DataFrame, bv: Mapping_, label: str, top: Mapping[int, int]) -> DataFrame:
    """Class midpoints; the options 2-21 are bands of 10000."""
    item = _c(bv[label])
    fixed = {1: 0, **top, -9: -9, -8: -7, -7: -8}
    return df.withColumn(label, first_match([
        *[(item == code, value) for code, value in fixed.items()],
        (item.between(2, 21), (item - 2) * 10000 + 5000)]))


def recode_rinc(df: DataFrame, bv: Mapping_, label: str = "TW_RINC") -> DataFrame:
    return _income(df, bv, label, codes.PERSONAL_INCOME)


def recode_inc(df: DataFrame, bv: Mapping_, label: str = "TW_INC") -> DataFrame:
    return _income(df, bv, label, codes.HOUSEHOLD_INCOME)


# ------------------------------------------------------------------------- lookups

def _country(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in COUNTRIES.items() for x in item])
    return F.try_element_at(table, F.coalesce(strip(text), F.lit("")))


def recode_born(df: DataFrame, bv: Mapping_, label: str) -> DataFrame:
    """Country of birth: the code first, then the open answer."""
    item, text = _c(bv[label]), _optional(df, "k" + bv[label], "string")
    return df.withColumn(label, first_match(
        code_map(item, {158: [1], 156: [2], -7: [-8], -9: [-7]}),
        F.coalesce(_country(text), F.lit(UNMAPPED))))


def born_names_used(df: DataFrame, bv: Mapping_, label: str) -> DataFrame:
    """Distinct country names that decided a code. ``df`` still holds the source columns."""
    item, text = _c(bv[label]), _optional(df, "k" + bv[label], "string")
    return (df.filter(~is_in(item, [1, 2, -7, -8]) & _country(text).isNotNull())
            .select(strip(text).alias("name")).distinct())


def recode_region(df: DataFrame) -> DataFrame:
    """Postcode to region; ``zipr`` if present, else ``zip``."""
    code = _c("zipr" if "zipr" in df.columns else "zip")
    return df.withColumn("TW_REG", first_match(
        [(code.between(lo, hi), region) for lo, hi, region in REGIONS]))


def household_design_weight(df: DataFrame) -> DataFrame:
    """household_r (capped at 6), result_txt (who is asked; kept if present), DWEIGHT_HH.
    NULL weight = no rule applies, see :func:`unmatched_design_weight`."""
    hh, rule = F.col("household_r"), F.col("sample_rule")
    df = df.withColumn("household_r", F.when(F.col("household") >= 6, F.lit(6))
                       .otherwise(F.col("household")))
    if "result_txt" not in df.columns:
        who = [(rule.isin(list(SELECTION)) & (hh == 1), ONLY)]
        for r, (tests, default) in SELECTION.items():
            who += [((rule == r) & (hh < n if op == "<" else hh == n), asked)
                    for op, n, asked in tests]
            who.append((rule == r, default))
        df = df.withColumn("result_txt", first_match(who, UNDEFINED))
    weights = [(size, who, n / 48) for size, table in DESIGN_WEIGHTS.items()
               for who, n in table.items()]
    lookup = literal_table(df.sparkSession, weights, "__size int, __who string, DWEIGHT_HH double")
    return df.join(F.broadcast(lookup), (hh == F.col("__size")) & (F.col("result_txt") == F.col("__who")),
                   "left").drop("__size", "__who")


def unmatched_design_weight(df: DataFrame) -> DataFrame:
    return df.filter(F.col("DWEIGHT_HH").isNull()).select(
        "id", "household_r", "sample_rule", "result_txt")


def recode_mode(df: DataFrame, col_za2: str = "za2", col_zb4: str = "zb4",
                col_zb604: str = "zb604") -> DataFrame:
    device, shown, helper = _c(col_za2), _c(col_zb4), _c(col_zb604)
    read_out_with_help = (device.isin(*codes.PAPER, *codes.COMPUTER) & shown.isin(*codes.READ_OUT)
                          & helper.isin(*codes.HELPED))
    modes = [(device.isin(*d) & shown.isin(*v) & helper.isin(*h), mode) for d, v, h, mode in codes.INTERVIEW_MODES]
    return df.withColumn("MODE", first_match([
        (read_out_with_help, UNMAPPED), *modes, (device == codes.NO_INTERVIEWER_DEVICE, UNMAPPED)], codes.OTHER_MODE))


# ------------------------------------------------------------------------- diagnostics

def report_invalid(df: DataFrame, label: str, source_cols: str | Sequence[str] | None = None) -> DataFrame:
    """Rows whose recode is -90, with the source columns that exist."""
    sources = [source_cols] if isinstance(source_cols, str) else list(source_cols or [])
    cols = [c for c in dict.fromkeys(["id", *sources, label]) if c in df.columns]
    return df.filter(_c(label) == UNMAPPED).select(*[_c(c) for c in cols])


def report_other_text(df: DataFrame, bv: Mapping_, label: str, other_codes: Sequence[int]) -> DataFrame:
    """Open text of rows recoded to an "other" code."""
    text = _optional(df, "k" + bv.get(label, ""), "string").alias("k" + bv.get(label, ""))
    chosen = is_in(_c(label), other_codes)
    return df.select("id", text, chosen.alias("__other")).filter("__other").drop("__other") \
        .dropna(subset=["k" + bv.get(label, "")])


def work_mainstat_conflicts(df: DataFrame, bv: Mapping_, work: str = "WORK",
                            mainstat: str = "MAINSTAT") -> DataFrame:
    """Recoded work and main status that contradict each other, with context columns."""
    w, m = _c(work), _c(mainstat)
    conflict = ((w == 2) & (m == 1)) | ((w == 1) & not_equal(m, 1))
    source = bv["SPMAINST"] if mainstat.startswith("SP") else bv["MAINSTAT"]
    cols = ["id", source, "k" + source, _work_source(bv, work), work, mainstat]
    if work == "WORK":
        cols.append(bv.get("TW_RINC"))
    isco = bv.get("SPISCO08" if work.startswith("SP") else "ISCO08", "")[:-2]
    cols += [isco + s for s in ("a1", "a2", "b1", "b2", "b3", "c")]
    return df.filter(F.coalesce(conflict, F.lit(False))).select(
        *[_c(c) for c in dict.fromkeys(cols) if c in df.columns])


def ethn_other_review(df: DataFrame, bv: Mapping_, label: str) -> DataFrame:
    """Recoded 7 although the original answer is not 9."""
    item = bv[label]
    cols = [c for c in ("id", item, "k" + item, label) if c in df.columns]
    return df.filter((_c(label) == 7) & not_equal(_c(item), 9)).select(*[_c(c) for c in cols])
