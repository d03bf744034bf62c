"""Table-driven data checks.

A check compiles its rules to a list of Columns, each a ``struct(content, reason)`` or NULL
per respondent, or an array of such structs. :func:`findings` turns any number of them into finding rows within a single
scan and without a shuffle, so all checks of a survey can share one pass over the data.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.missing import is_in
from ..functions.text import WHITESPACE, is_blank, natural_key, shown, strip
from ..plans import pyrules
from ..plans.appellations import APPELLATIONS
from ..plans.small import fence
from ..plans.rules import (bind, boolean_rule, missing_columns, names, quoted, report, rule_rows,
                           text_literal, word_array)

SEPARATOR = "，"
KEY = ["no", "id", "content", "reason"]
SKIPPED = -6
COMPLETED = "完訪: 100"
GAP_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"
# the forms of an answer time besides ISO: how it looks, and how it is read (with the day first: the second one)
_CLOCK = {"": "", " +[0-9]{1,2}:[0-9]{2}": " H:mm", " +[0-9]{1,2}:[0-9]{2}:[0-9]{2}": " H:mm:ss"}
TIME_FORMS = {**{rf"[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}{c}": (f"yyyy/M/d{f}",) * 2 for c, f in _CLOCK.items()},
              **{rf"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{c}": (f"M/d/yyyy{f}", f"d/M/yyyy{f}") for c, f in _CLOCK.items()},
              "[0-9]{14}": ("yyyyMMddHHmmss",) * 2}
_AMBIGUOUS = r"\A0?([1-9]|1[0-2])/(?!0?\1/)0?([1-9]|1[0-2])/[0-9]{4}(?![0-9])"

Checks = list[Column]


def _col(name: str) -> Column:
    return F.col(quoted(name))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _codes(df: DataFrame, name: str, values: Sequence) -> list:
    """Rule codes in the type of the column they are compared with."""
    return [str(v) for v in values] if _is_text(df, name) else list(values)


def _measure(df: DataFrame, name: str) -> Column:
    """A column to compare by size; text that is no number gives NULL."""
    return _col(name).try_cast("double") if _is_text(df, name) else _col(name)


def _pairs(cols: Sequence[str]) -> Column:
    """``a=1，b=2``"""
    if not cols:
        return F.lit("")
    return F.concat_ws(SEPARATOR, *[F.concat(F.lit(f"{c}="), shown(_col(c))) for c in cols])


def _finding(condition: Column, content: Column, reason: str) -> Column:
    return F.when(condition, F.struct(content.alias("content"), F.lit(reason).alias("reason")))


def findings(df: DataFrame, checks: Iterable[Column], survey: str = "") -> DataFrame:
    """Finding rows (survey, no, id, content, reason, reply, wave, note) of compiled checks."""
    checks = list(checks)
    if not checks:
        none = F.struct(F.lit("").alias("content"), F.lit("").alias("reason"))
        checks = [F.when(F.lit(False), none)]
    base = ["no", "id", "wave"]
    kinds = dict(df.select(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).dtypes)
    single = [c for i, c in enumerate(checks) if not kinds[f"c{i}"].startswith("array")]
    arrays = [F.coalesce(c, F.array().cast(kinds[f"c{i}"])) for i, c in enumerate(checks) if kinds[f"c{i}"].startswith("array")]
    # nulls go after the explode: a filter on the array would be a lambda, and all below a lambda is interpreted
    found = F.concat(*([F.array(*single)] if single else []), *arrays) if arrays else F.array(*single)
    rows = df.select(*base, found.alias("found"))
    return (fence(rows, "found").select(*base, F.explode("found").alias("f")).where("f IS NOT NULL")
            .select(F.lit(survey).alias("survey"), "no", "id", "f.content", "f.reason",
                    F.lit("").alias("reply"), "wave", F.lit("").alias("note")))


# ------------------------------------------------------------------------ rule compilers

def single_note_checks(df: DataFrame, rules, errors: list[str] | None = None) -> Checks:
    """Open text that is missing although the answer asks for it, or present although no
    allowed answer was chosen."""
    rows = rule_rows(rules)
    allowed: dict[str, list] = {}
    for r in rows:
        allowed.setdefault(r["ori_item"], []).append(r["value"])
    out = []
    for r in rows:
        item, note = r["ori_item"], r["note_item"]
        absent = missing_columns(df, [item, note])
        if absent:
            report(errors, f"note rule {item}/{note}: no column {absent}")
            continue
        extra = [c for c in names(r.get("add_output")) if c in df.columns]
        content = _pairs([item, note, *extra])
        blank = is_blank(_col(note))
        if item.startswith("x3c"):
            blank = blank | F.coalesce(_measure(df, note) == SKIPPED, F.lit(False))
        out.append(F.coalesce(
            _finding(is_in(_col(item), _codes(df, item, [r["value"]])) & blank, content,
                     f"{item}_開放題未填"),
            _finding(~is_in(_col(item), _codes(df, item, allowed[item])) & ~blank, content,
                     f"{item}_所選選項不應填答開放題")))
    return out


def multi_note_checks(df: DataFrame, pairs: Sequence[tuple[str, str]],
                      errors: list[str] | None = None) -> Checks:
    """(item, note) pairs: the note is filled exactly when item = 1."""
    out = []
    for item, note in pairs:
        absent = missing_columns(df, [item, note])
        if absent:
            report(errors, f"multi note rule {item}/{note}: no column {absent}")
            continue
        blank = is_blank(_col(note), trimmed=False)
        ticked = is_in(_col(item), _codes(df, item, [1]))
        content = _pairs([item, note])
        out.append(F.coalesce(_finding(ticked & blank, content, f"{item}_開放題未填"),
                              _finding(~ticked & ~blank, content, f"{item}_所選選項不應填答開放題")))
    return out


def work_note_checks(df: DataFrame, bases: Sequence[str]) -> Checks:
    """Blank open fields of a work block; only the first failing block of a row is reported."""
    found = []
    for base in bases:
        cols = [c for c in (base + s for s in ("a1", "a2", "b1", "b2", "b3")) if c in df.columns]
        if cols:
            any_blank = F.lit(False)
            for c in cols:
                any_blank = any_blank | is_blank(_col(c), trimmed=False)
            found.append(_finding(any_blank, _pairs(cols), f"{base}_工作題開放欄位未填答"))
    return [F.coalesce(*found)] if found else []


PHONES = ("cell1", "cell2", "phone1", "phone2")


def _phone_digits(raw: Column) -> Column:
    """A number without the symbols that may stand in it."""
    out = F.translate(raw, "#-轉", "")
    for word in ("分機", "ext", " "):
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.btrim(out, F.lit(WHITESPACE))


def phone_checks(df: DataFrame, errors: list[str] | None = None) -> Checks:
    """No way to reach the respondent; malformed land lines; short or malformed mobiles."""
    absent = missing_columns(df, PHONES)
    if absent:
        report(errors, f"phone check: no column {absent}")
        return []
    unreachable = F.lit(True)
    for v in PHONES:
        unreachable = unreachable & shown(_col(v)).isin("0", "-8")
    out = [_finding(unreachable, _pairs(PHONES), "完全沒有連絡電話或全拒答")]
    return out + [_phone_check(v) for v in PHONES]


def _phone_check(v: str) -> Column:
    def finding(raw: Column, reason: str) -> Column:
        return F.struct(F.concat(F.lit(f"{v}="), raw).alias("content"), F.lit(f"{v}_{reason}").alias("reason"))

    # plain expressions, though some are written twice: what stands in a lambda is interpreted
    raw = strip(shown(_col(v)))
    digits, malformed = _phone_digits(raw), finding(raw, "號碼格式有誤，請確認")
    if v.startswith("phone"):
        bad = F.when(~digits.rlike(r"\A\p{Nd}+\z"), malformed)
    else:  # one test lets every good number pass
        bad = F.when(~digits.rlike(r"\A09\p{Nd}{8,}\z"), F.when(F.length(digits) < 10, finding(raw, "號碼少於10碼")).otherwise(malformed))
    # numbers written as most are need no cleaning to be seen as good, whatever symbols are taken out
    good = r"\A(?:[-# 轉]|分機|ext)*+[0-9](?:[-# 轉0-9]|分機|ext)*+\z" if v.startswith("phone") else r"\A09(?:-?[0-9]){8,}+\z"
    return F.when(~(raw.isin("0", "-8", "") | raw.rlike(good)), bad)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def filled_note_checks(df: DataFrame, rules, multi_rules, wave: str | None,
                       note_exclude: Sequence[str] = ()) -> Checks:
    """Every filled note of the current wave, for review."""
    item_of = {r["note_item"]: r["ori_item"] for r in rule_rows(rules)}
    item_of.update({r["note_item"]: r["ori_item"] for r in rule_rows(multi_rules)
                    if r["ori_item"] != "connect" and "z" not in r["note_item"]})
    current = (F.lit(True) if wave is None or "wave" not in df.columns
               else F.coalesce(F.col("wave") == F.lit(wave), F.lit(False)))
    out = []
    for note, item in item_of.items():
        if (note not in df.columns or note in note_exclude or note == "email"
                or "x" in note or "z" in note):
            continue
        shown_cols = [item, note] if item in df.columns else [note]
        out.append(_finding(current & ~is_blank(_col(note)), _pairs(shown_cols),
                            f"{note}_請確認答案是否可以歸類"))
    return out


RULES_AS_DATA = 100


def range_checks(df: DataFrame, rules) -> Checks:
    """Values outside [min, max] that are not a special code; absent columns are passed over. More than ``RULES_AS_DATA`` rules are no longer an
    expression each but one over arrays (:func:`range_check_of_many`), with the same findings."""
    rows = [r for r in rule_rows(rules) if r["var"] in df.columns]
    if len(rows) > RULES_AS_DATA:
        return [range_check_of_many(df, rows)]
    out = []
    for r in rows:
        v = r["var"]
        value, special = _measure(df, v), [int(float(s)) for s in names(r["special_code"])]
        outside = F.lit(False)
        if r["min"] is not None:
            outside = outside | (value < F.lit(r["min"]))
        if r["max"] is not None:
            outside = outside | (value > F.lit(r["max"]))
        out.append(_finding(outside & ~is_in(value, special), _pairs([v]), f"{v}_數值不合理"))
    return out


def range_check_of_many(df: DataFrame, rows: Sequence[dict]) -> Column:
    """The findings of any number of range rules as one array. The rules are constants of the plan (which value, its bounds, its special codes);
    the ruled values of a row stand in an array that is compared with them, and cells are written as text only for rows with a finding. So the code that
    is generated does not grow with the rules, and the data is read once, without a row per cell."""
    place = {v: k for k, v in enumerate(dict.fromkeys(r["var"] for r in rows))}

    def constants(values: Iterable[str], kind: str) -> Column:
        return F.expr(f"cast(array({', '.join(values)}) as array<{kind}>)")

    def number(value) -> str:
        return "NULL" if value is None else f"double('{float(value)!r}')"

    special = [f"array({', '.join(number(s) for s in names(r['special_code']))})" for r in rows]
    table = F.arrays_zip(constants([str(place[r["var"]]) for r in rows], "int").alias("k"),
                         constants([number(r["min"]) for r in rows], "double").alias("low"),
                         constants([number(r["max"]) for r in rows], "double").alias("high"),
                         constants(special, "array<double>").alias("special"),
                         constants([text_literal(r["var"]) for r in rows], "string").alias("var"))
    values = F.array(*[_measure(df, v).cast("double") for v in place])

    def failing(held: Column) -> Column:
        def fails(rule: Column) -> Column:
            def of(x: Column) -> Column:
                outside = F.coalesce(x < rule["low"], F.lit(False)) | F.coalesce(x > rule["high"], F.lit(False))
                return outside & ~F.array_contains(rule["special"], x)
            value = F.get(held, rule["k"])
            return F.coalesce(of(value), F.lit(False))
        return F.filter(table, fails)

    def written(found: Column) -> Column:
        cells = F.array(*[shown(_col(v)) for v in place])
        return _once(cells, lambda c: F.transform(found, lambda rule: F.struct(
            F.concat(rule["var"], F.lit("="), F.get(c, rule["k"])).alias("content"), F.concat(rule["var"], F.lit("_數值不合理")).alias("reason"))))

    return _once(_once(values, failing), lambda found: F.when(F.size(found) > 0, written(found)))


def multi_response_checks(df: DataFrame, rules, errors: list[str] | None = None) -> Checks:
    """No box ticked in ``base01..baseNN``."""
    out = []
    for r in rule_rows(rules):
        base = r["muti_item"]
        cols = [f"{base}{i:02d}" for i in range(1, int(r["max"]) + 1)]
        absent = missing_columns(df, cols)
        if absent:
            report(errors, f"multi response rule {base}: no column {absent}")
            continue
        ticked = F.lit(0)
        for c in cols:
            ticked = ticked + F.coalesce(_measure(df, c), F.lit(0))
        out.append(_finding(ticked == 0, _pairs(cols), f"{base}_複選題全未勾選"))
    return out


def _python_rule(df: DataFrame, text: str, columns: Mapping[str, str], constants: Mapping[str, pyrules.Value], where: str,
                 errors: list[str] | None) -> pyrules.Value | None:
    """A rule written in Python, or None with the reason reported."""
    try:
        rule = pyrules.compile_rule(text, {**constants, **{n: pyrules.column(df, c) for n, c in columns.items()}})
        if rule.raises is pyrules.ALWAYS:
            raise pyrules.RuleError("raises for every row")
        return rule
    except pyrules.RuleError as problem:
        report(errors, f"{where}: {problem}")
        return None


def _skip_rule(df: DataFrame, r: dict, errors: list[str] | None, language: str) -> pyrules.Value | Column | None:
    a, b = r.get("triggerA"), r.get("triggerB")
    text, where = str(r.get("condition") or ""), f"skip rule {r.get('description')!r}"
    if (r.get("language") or language) == "python":
        absent = {"a": pyrules.constant(None), "b": pyrules.constant("")}
        return _python_rule(df, text, {n: c for n, c in (("a", a), ("b", b)) if c in df.columns}, absent, where, errors)
    return boolean_rule(df, bind(text, {"a": quoted(a) if a in df.columns else "NULL", "b": quoted(b) if b in df.columns else "''"}),
                        where, errors)


def skip_checks(df: DataFrame, rules, wrongly_skipped: bool = False,
                errors: list[str] | None = None, language: str = "sql") -> Checks:
    """``condition`` (over ``a`` = triggerA and ``b`` = triggerB, in SQL or Python) holds and

    - any listed variable was answered although it should be skipped, or
    - with ``wrongly_skipped`` all listed variables were skipped.

    A rule's own ``language`` goes before the one given.
    """
    out = []
    for r in rule_rows(rules):
        condition = _skip_rule(df, r, errors, language)
        if condition is None:
            continue
        if isinstance(condition, pyrules.Value):
            condition = pyrules.holds(condition)
        listed = [c for c in names(r.get("skip_num")) + names(r.get("skip_str"))
                  if c in df.columns]
        skipped = [is_in(_col(c), _codes(df, c, [SKIPPED])) for c in listed]
        verdict = F.lit(wrongly_skipped)
        for s in skipped:
            verdict = (verdict & s) if wrongly_skipped else (verdict | ~s)
        shown_cols = [c for c in names(r.get("output")) if c in df.columns]
        out.append(_finding(condition & verdict, _pairs(shown_cols), str(r.get("description"))))
    return out


def _logic_rules(df: DataFrame, rules, appellations: Mapping[str, Sequence[str]] | None, errors: list[str] | None,
                 language: str) -> list[tuple[dict, pyrules.Value | Column]]:
    """Every rule that can be compiled, over ``it1..itN`` and the keyword groups."""
    groups = {f"{g}_appellation": list(words) for g, words in (appellations or APPELLATIONS).items()}
    out = []
    for r in rule_rows(rules):
        where, cols, shown_cols = f"logic rule {r['check_no']}", names(r["var_list"]), names(r["out_var"])
        absent = missing_columns(df, cols + shown_cols)
        if absent:
            report(errors, f"{where}: no column {absent}")
            continue
        its, text = {f"it{i}": c for i, c in enumerate(cols, 1)}, str(r["check_rule"])
        if (r.get("language") or language) == "python":
            rule = _python_rule(df, text, its, {g: pyrules.words(w) for g, w in groups.items()}, where, errors)
        else:
            rule = boolean_rule(df, bind(text, {**{g: word_array(w) for g, w in groups.items()},
                                                **{n: quoted(c) for n, c in its.items()}}), where, errors)
        if rule is not None:
            out.append((r, rule))
    return out


def logic_checks(df: DataFrame, rules, appellations: Mapping[str, Sequence[str]] | None = None,
                 errors: list[str] | None = None, language: str = "sql") -> Checks:
    """User rules over ``it1..itN`` (the variables of the rule) and the keyword groups ``<group>_appellation``: arrays in SQL, lists in Python.
    An SQL rule without an answer counts as false; where a Python rule raises there is no finding. A rule's own ``language``
    goes before the one given."""
    out = []
    for r, rule in _logic_rules(df, rules, appellations, errors, language):
        wanted = r["TorF"] == "T"
        if isinstance(rule, pyrules.Value):
            result = pyrules.answers(rule, wanted)
        else:
            result = F.coalesce(rule, F.lit(False))
            result = result if wanted else ~result
        out.append(_finding(result, _pairs(names(r["out_var"])), f"{r['check_no']}_{r['description']}"))
    return out


def rule_failures(df: DataFrame, rules, appellations: Mapping[str, Sequence[str]] | None = None,
                  errors: list[str] | None = None) -> DataFrame:
    """``check_no``, ``rows``, ``raised``: for how many rows a logic rule written in Python raises, as it does when the length of a missing text is
    asked for. One aggregation over the data."""
    made = _logic_rules(df, rules, appellations, errors, "python")
    counts = [F.struct(F.lit(str(r["check_no"])).alias("check_no"), F.count(F.lit(1)).alias("rows"),
                       F.count_if(pyrules.raising(rule)).alias("raised")) for r, rule in made if isinstance(rule, pyrules.Value)]
    if not counts:
        counts = [F.struct(F.lit("").alias("check_no"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("raised"))]
        return df.limit(0).agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("check_no <> ''")
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def response_note_checks(df: DataFrame) -> Checks:
    return [_finding(~is_blank(_col(v), trimmed=False), _pairs([v]), "請確認訪員回報的內容")
            for v in ("note1", "note2", "text") if v in df.columns]


# ------------------------------------------------------------------------ checks as tables

def check_single_note(df, rules, survey="", errors=None) -> DataFrame:
    return findings(df, single_note_checks(df, rules, errors), survey)


def check_multi_note(df, pairs, survey="", errors=None) -> DataFrame:
    return findings(df, multi_note_checks(df, pairs, errors), survey)


def check_work_note(df, bases, survey="") -> DataFrame:
    return findings(df, work_note_checks(df, bases), survey)


def check_phone_format(df, survey="", errors=None) -> DataFrame:
    return findings(df, phone_checks(df, errors), survey)


def check_filled_notes(df, rules, multi_rules, wave, note_exclude=(), survey="") -> DataFrame:
    return findings(df, filled_note_checks(df, rules, multi_rules, wave, note_exclude), survey)


def check_note(df: DataFrame, rules, multi_rules, pairs, work_bases, wave, note_exclude=(),
               survey: str = "", errors: list[str] | None = None) -> DataFrame:
    """All five note checks in one scan."""
    return findings(df, [*single_note_checks(df, rules, errors),
                         *multi_note_checks(df, pairs, errors),
                         *work_note_checks(df, work_bases), *phone_checks(df, errors),
                         *filled_note_checks(df, rules, multi_rules, wave, note_exclude)], survey)


def check_range(df, rules, survey="") -> DataFrame:
    return findings(df, range_checks(df, rules), survey)


def check_multi_response(df, rules, survey="", errors=None) -> DataFrame:
    return findings(df, multi_response_checks(df, rules, errors), survey)


def check_skip(df, rules, survey="", errors=None, language="sql") -> DataFrame:
    return findings(df, skip_checks(df, rules, False, errors, language), survey)


def check_skip2(df, rules, survey="", errors=None, language="sql") -> DataFrame:
    return findings(df, skip_checks(df, rules, True, errors, language), survey)


def check_logic(df, rules, appellations=None, survey="", errors=None, language="sql") -> DataFrame:
    return findings(df, logic_checks(df, rules, appellations, errors, language), survey)


def check_response_notes(df, survey="") -> DataFrame:
    return findings(df, response_note_checks(df), survey)


# ------------------------------------------------------------------------ time gaps

def answer_time_columns(df: DataFrame) -> list[str]:
    """Answer-time columns in natural order; ``record`` columns are not answer times."""
    return sorted((c for c in df.columns if "ansTime" in c and "record" not in c),
                  key=natural_key)


def answer_times(df: DataFrame) -> DataFrame:
    """The full time table of the completed interviews."""
    base = [c for c in ("no", "id", "status") if c in df.columns]
    return (df.filter(F.col("status") == COMPLETED)
            .select(*base, *[_col(c) for c in answer_time_columns(df)]))


def _time(col: Column, day_first: bool) -> Column:
    """An answer time in any of the known forms, NULL if it has none of them. What it looks like tells the form, so a value is parsed once."""
    text = strip(col.cast("string"))
    out = F.when(text.rlike(r"\A[0-9]{4}-"), text.try_cast("timestamp_ntz"))
    for looks, forms in TIME_FORMS.items():
        single = F.regexp_replace(text, " +", " ") if "+" in looks else text
        out = out.when(text.rlike(rf"\A{looks}\z"), F.try_to_timestamp(single, F.lit(forms[day_first])).cast("timestamp_ntz"))
    return out.otherwise(text.try_cast("timestamp_ntz"))


def time_gap_report(df: DataFrame, threshold_minutes: float = 10, day_first: bool = False) -> DataFrame:
    """One row per completed interview: does any pair of neighbouring answer times lie more
    than the threshold apart, and which pairs.

    The times of one interview stand in one row, so neighbours are compared there: no
    unpivot, window or shuffle. An unreadable time breaks the pairs on both sides and is counted in ``unreadable``.
    ``3/4/2024`` is read with the month first, or with the day first if told so; :func:`ambiguous_times` counts such times.
    """
    cols = answer_time_columns(df)
    done = answer_times(df)
    base = [c for c in done.columns if c not in cols]
    given = F.array(*[~is_blank(_col(c)) for c in cols]) if cols else F.array().cast("array<boolean>")
    times = F.array(*[_time(_col(c), day_first) for c in cols]) if cols else F.array().cast("array<timestamp_ntz>")
    parsed = done.select(*base, times.alias("times"), given.alias("given"))
    unreadable = F.size(F.filter(F.arrays_zip("times", "given"), lambda x: x["given"] & x["times"].isNull()))
    gaps = []
    for i, (left, right) in enumerate(zip(cols, cols[1:])):
        t1, t2 = F.col("times")[i], F.col("times")[i + 1]
        minutes = F.timestamp_diff("MICROSECOND", t1, t2) / F.lit(6e7)
        gaps.append(F.when(minutes > threshold_minutes, F.concat(
            F.lit(f"{left} = "), F.date_format(t1, GAP_TIME_FORMAT),
            F.lit(f"{SEPARATOR}{right} = "), F.date_format(t2, GAP_TIME_FORMAT))))
    details = (F.filter(F.array(*gaps), lambda g: g.isNotNull()) if gaps
               else F.array().cast("array<string>"))
    return (parsed.select(*base, details.alias("details"), unreadable.alias("unreadable"))
            .select(*base, (F.size("details") > 0).alias("flag"), "details", "unreadable"))


def ambiguous_times(df: DataFrame) -> DataFrame:
    """``variable``, ``n``: how many answer times of each column of the completed interviews are other days if the day stands first."""
    done, cols = answer_times(df), answer_time_columns(df)
    counts = [F.struct(F.lit(c).alias("variable"), F.count_if(strip(_col(c).cast("string")).rlike(_AMBIGUOUS)).alias("n")) for c in cols]
    none = F.array().cast("array<struct<variable:string,n:bigint>>")
    return done.agg(F.count(F.lit(1)), (F.array(*counts) if counts else none).alias("t")).select(F.inline("t"))


# ------------------------------------------------------------------------ reports

def remove_handled(now: DataFrame, handled: DataFrame, drop_all_copies: bool = False) -> DataFrame:
    """Findings that no earlier report contains, ordered by content; NULL keys compare equal.

    The handled keys are made distinct first, so a key repeated over many reports is one row
    by the time of the join. ``drop_all_copies`` also drops findings that occur more than
    once in ``now``, every copy of them.
    """
    past = handled.select(*[F.col(k).cast("string").alias(f"past_{k}") for k in KEY]).distinct()
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).cast("string").eqNullSafe(F.col(f"past_{k}"))
    kept = now
    if drop_all_copies:
        rest = [c for c in now.columns if c not in KEY]
        kept = (now.groupBy(*KEY)
                .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*rest)).alias("rest"))
                .filter("copies = 1").select(*KEY, "rest.*").select(*now.columns))
    # the keys after content only break ties, so that one frequent content is not one sort task
    return kept.join(past, same, "left_anti").orderBy("content", "id", "no", "reason")


def drop_duplicate_findings(df: DataFrame) -> DataFrame:
    """One row per (no, id, content, reason). Which copy stays does not depend on row order."""
    rest = [c for c in df.columns if c not in KEY]
    return (df.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("rest"))
            .select(*KEY, "rest.*").select(*df.columns))


def findings_report(found: DataFrame, handled: DataFrame | None = None, wave: str | None = None,
                    init_waves: Sequence[str] = ("00", "01"),
                    drop_all_copies: bool = False) -> DataFrame:
    """The report of a wave, ordered by content: distinct findings, minus the handled ones unless the wave is an
    initial one. Keys are compared as text, so a handled id need not be a number.

    Copies and handled keys meet in one aggregation, partial before the exchange, so neither
    a finding repeated a billion times nor a key handled every week makes a hot task.
    """
    order = ["content", "id", "no", "reason"]
    if handled is None or wave in init_waves:
        return drop_duplicate_findings(found).orderBy(*order)
    text = {k: f"__{k}" for k in KEY}
    rest = [c for c in found.columns if c not in KEY]
    current = found.select(*[F.col(k).cast("string").alias(t) for k, t in text.items()],
                           F.struct(*KEY, *rest).alias("row"), F.lit(0).alias("past"))
    past = handled.select(*[F.col(k).cast("string").alias(t) for k, t in text.items()]).withColumns(
        {"row": F.lit(None).cast(current.schema["row"].dataType), "past": F.lit(1)})
    merged = current.unionByName(past).groupBy(*text.values()).agg(
        F.max("past").alias("past"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    keep = F.col("past") == 0
    if drop_all_copies:
        keep = keep & (F.col("copies") == 1)
    return merged.filter(keep).select("row.*").select(*found.columns).orderBy(*order)
