"""Data checks and findings reports."""
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import gaps as G
from ..operators import handled as H
from ..plans.small import run_folder
from .base import more, resp, table, with_resp

SURVEY = "panel"
NOTE_RULES = [
    {"ori_item": "opinion", "note_item": "kc1", "value": 2, "add_output": "gender@not_there"},
    {"ori_item": "opinion", "note_item": "kc1", "value": 3, "add_output": None},
    {"ori_item": "area", "note_item": "note1", "value": 6, "add_output": "agegp@edugp"},
    {"ori_item": "x3c1", "note_item": "s2", "value": 1, "add_output": None}]
MULTI_NOTE_RULES = [{"note_item": "note1", "ori_item": "m01"},
                    {"note_item": "kc2", "ori_item": "connect"}]
NOTE_PAIRS = [("m01", "note1"), ("m03", "kc1")]
WORK_BASES = ["w1", "w2"]
RANGES = [{"var": "score", "min": 0.0, "max": 90.0, "special_code": "95@99"},
          {"var": "c1", "min": 1.0, "max": 20.0, "special_code": "-8@-7"},
          {"var": "not_there", "min": 0.0, "max": 1.0, "special_code": None}]
EVENT_RANGES = [{"var": "value", "min": 1.0, "max": 120.0, "special_code": None}]
MULTI = [{"muti_item": "m", "max": 3}]
SKIPS = [{"triggerA": "gender", "triggerB": "area", "condition": "a = 1 AND b IN (1, 3)",
          "description": "should skip", "output": "gender@area@s1@s2", "skip_num": "s1", "skip_str": "s2"},
         {"triggerA": "opinion", "triggerB": "", "condition": "a >= 3", "description": "skip nothing",
          "output": "opinion", "skip_num": "", "skip_str": ""}]
SKIPS2 = [{"triggerA": "gender", "triggerB": "", "condition": "a = 2 AND b = ''",
           "description": "wrongly skipped", "output": "gender@s1@s2", "skip_num": "s1", "skip_str": "s2"},
          {"triggerA": "agegp", "triggerB": "", "condition": "a = 5", "description": "empty list",
           "output": "agegp", "skip_num": "", "skip_str": ""}]
LOGIC = [{"check_no": "L1", "var_list": "gender@who", "TorF": "T", "out_var": "gender@who",
          "check_rule": "it1 = 2 AND exists(male_appellation, k -> contains(it2, k))",
          "description": "address does not fit"},
         {"check_no": "L2", "var_list": "agegp@edugp", "TorF": "F", "out_var": "agegp@edugp",
          "check_rule": "it1 + it2 < 7", "description": "too much"}]

# the rules above and more, as users write them
PY_SKIPS = [{**SKIPS[0], "condition": "a == 1 and b in [1, 3]"}, {**SKIPS[1], "condition": "a >= 3"}]
PY_SKIPS2 = [{**SKIPS2[0], "condition": "a == 2 and b == ''"}, {**SKIPS2[1], "condition": "a == 5"}]
PY_LOGIC = [{**LOGIC[0], "check_rule": "it1 == 2 and any(k in it2 for k in male_appellation)"},
            {**LOGIC[1], "check_rule": "it1 + it2 < 7"}]
PY_FORMS = [
    {"check_no": "P1", "var_list": "who@gender", "TorF": "T", "out_var": "who",
     "check_rule": "isinstance(it1, str) and it1.startswith('李')\nand it2 != 1", "description": "name"},
    {"check_no": "P2", "var_list": "m01@m02@m03", "TorF": "T", "out_var": "m01@m02@m03",
     "check_rule": "sum(1 for m in [it1, it2, it3] if m == 1) > 1", "description": "boxes"},
    {"check_no": "P3", "var_list": "score@c1", "TorF": "F", "out_var": "score",
     "check_rule": "0 <= it1 <= 100 or it2 // 4 == -2", "description": "bounds"},
    {"check_no": "P4", "var_list": "agegp@edugp@opinion", "TorF": "T", "out_var": "agegp",
     "check_rule": "len(set([it1, it2, it3])) == 1", "description": "all alike"},
    {"check_no": "P5", "var_list": "who", "TorF": "F", "out_var": "id", "check_rule": "len(it1) > 2 and it1[-2:] == '先生'",
     "description": "no finding where the text is missing"}]


def _flat(df):
    """Array columns as text, so the rows can be compared."""
    return df.withColumn("details", F.array_join("details", "|"))


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("no"),
        F.col("event_type").alias("wave"), "value")


def _found(spark, sf):
    """Range findings, every score finding twice."""
    rules = [*RANGES, RANGES[0]]
    return C.check_range(resp(spark, sf), rules, SURVEY)


def _handled(spark, sf):
    """What the office has dealt with: the findings of the first wave and of interviewer n1."""
    return _found(spark, sf).filter("wave = 'w00' OR no = 'n1'")


def _by_key_table(spark, sf):
    """The handled keys grow by two reports, one of which comes twice; then the table is opened again."""
    path, handled = run_folder(spark, "handled"), _handled(spark, sf)
    name = H.open_handled(spark, path, 8)
    for part in ("wave = 'w00'", "wave <> 'w00'", "no = 'n1'"):
        H.add_handled(name, handled.filter(part))
    return H.unhandled(_found(spark, sf), H.open_handled(spark, path, 8), wave="02")


QUERIES = {
    "check_note": lambda spark, sf: C.check_note(
        more(spark, sf), NOTE_RULES, MULTI_NOTE_RULES, NOTE_PAIRS, WORK_BASES, "w01", survey=SURVEY),
    "check_single_note": lambda spark, sf: C.check_single_note(more(spark, sf), NOTE_RULES, SURVEY),
    "check_multi_note": lambda spark, sf: C.check_multi_note(resp(spark, sf), NOTE_PAIRS, SURVEY),
    "check_work_note": lambda spark, sf: C.check_work_note(resp(spark, sf), WORK_BASES, SURVEY),
    "check_phone_format": lambda spark, sf: C.check_phone_format(resp(spark, sf), SURVEY),
    "check_filled_notes": lambda spark, sf: C.check_filled_notes(
        more(spark, sf), NOTE_RULES, MULTI_NOTE_RULES, "w01", survey=SURVEY),
    "check_response_notes": lambda spark, sf: C.check_response_notes(resp(spark, sf), SURVEY),
    "check_range": lambda spark, sf: C.check_range(resp(spark, sf), RANGES, SURVEY),
    "check_range_events": lambda spark, sf: C.check_range(_events(spark, sf), EVENT_RANGES, SURVEY),
    "check_multi_response": lambda spark, sf: C.check_multi_response(resp(spark, sf), MULTI, SURVEY),
    "check_skip": lambda spark, sf: C.check_skip(resp(spark, sf), SKIPS, SURVEY),
    "check_skip2": lambda spark, sf: C.check_skip2(resp(spark, sf), SKIPS2, SURVEY),
    "check_logic": lambda spark, sf: C.check_logic(more(spark, sf), LOGIC, survey=SURVEY),
    "check_skip_python": lambda spark, sf: C.check_skip(resp(spark, sf), PY_SKIPS, SURVEY, language="python"),
    "check_skip2_python": lambda spark, sf: C.check_skip2(resp(spark, sf), PY_SKIPS2, SURVEY, language="python"),
    "check_logic_python": lambda spark, sf: C.check_logic(more(spark, sf), PY_LOGIC, survey=SURVEY, language="python"),
    "check_logic_python_forms": lambda spark, sf: C.check_logic(more(spark, sf), PY_FORMS, survey=SURVEY, language="python"),
    "rule_failures": lambda spark, sf: C.rule_failures(more(spark, sf), [*PY_LOGIC, *PY_FORMS]),
    "time_gap_report": lambda spark, sf: _flat(C.time_gap_report(resp(spark, sf), 10)),
    "remove_handled": lambda spark, sf: C.remove_handled(_found(spark, sf), _handled(spark, sf)),
    "remove_handled_all_copies": lambda spark, sf: C.remove_handled(
        _found(spark, sf), _handled(spark, sf), drop_all_copies=True),
    "event_gaps": lambda spark, sf: G.event_gaps(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", 600, ["event_id"]).select(
        "user_id", "event_id", "event_type", F.col("previous.event_id").alias("previous_event"), F.round("minutes", 4).alias("minutes")),
    "time_gap_slashes": lambda spark, sf: _flat(C.time_gap_report(resp(spark, sf).withColumns(
        {c: F.replace(c, F.lit("2024-01-01"), F.lit("2024/1/1")) for c in ("t1_ansTime", "t2_ansTime", "t10_ansTime")}))),
    "check_range_open_bounds": lambda spark, sf: C.check_range(resp(spark, sf), [
        {"var": "score", "min": float("nan"), "max": 90.0, "special_code": "95@99"},
        {"var": "c1", "min": 1.0, "max": None, "special_code": "-8@-7"}], SURVEY),
    "check_single_note_number": lambda spark, sf: C.check_single_note(
        more(spark, sf).withColumn("s2", F.try_to_number("s2", F.lit("S99")).cast("double")),
        [r for r in NOTE_RULES if r["note_item"] == "s2"], SURVEY),
    "findings_report_text_ids": lambda spark, sf: C.findings_report(
        _found(spark, sf), _handled(spark, sf).withColumn("id", F.col("id").cast("string")).unionByName(
            _handled(spark, sf).withColumn("id", F.lit("A12"))), wave="02"),
    "findings_report": lambda spark, sf: C.findings_report(
        _found(spark, sf), _handled(spark, sf), wave="02"),
    "findings_report_key_table": _by_key_table,
    "findings_report_initial": lambda spark, sf: C.findings_report(
        _found(spark, sf), _handled(spark, sf), wave="00"),
}


def _content(cols):
    return " || '，' || ".join(f"'{c}=' || COALESCE(CAST({c} AS VARCHAR), 'nan')" for c in cols)


def _select(source, condition, content, reason):
    return (f"SELECT '{SURVEY}' AS survey, no, id, {content} AS content, '{reason}' AS reason, '' AS reply, wave, "
            f"'' AS note FROM {source} WHERE {condition}")


def _union(parts):
    return " UNION ALL ".join(parts)


def _note_parts():
    missing, extra = "{}_開放題未填", "{}_所選選項不應填答開放題"
    blank, s2_blank = "TRIM(COALESCE({}, '')) = ''", "(TRIM(COALESCE(s2, '')) = '' OR s2 = '-6')"
    k, n = blank.format("kc1"), blank.format("note1")
    return [
        _select("more", f"opinion = 2 AND {k}", _content(["opinion", "kc1", "gender"]), missing.format("opinion")),
        _select("more", f"COALESCE(opinion, 0) NOT IN (2, 3) AND NOT {k}", _content(["opinion", "kc1", "gender"]), extra.format("opinion")),
        _select("more", f"opinion = 3 AND {k}", _content(["opinion", "kc1"]), missing.format("opinion")),
        _select("more", f"COALESCE(opinion, 0) NOT IN (2, 3) AND NOT {k}", _content(["opinion", "kc1"]), extra.format("opinion")),
        _select("more", f"area = 6 AND {n}", _content(["area", "note1", "agegp", "edugp"]), missing.format("area")),
        _select("more", f"area <> 6 AND NOT {n}", _content(["area", "note1", "agegp", "edugp"]), extra.format("area")),
        _select("more", f"x3c1 = 1 AND {s2_blank}", _content(["x3c1", "s2"]), missing.format("x3c1")),
        _select("more", f"x3c1 <> 1 AND NOT {s2_blank}", _content(["x3c1", "s2"]), extra.format("x3c1"))]


def _pair_parts():
    parts = []
    for item, note in NOTE_PAIRS:
        blank = f"COALESCE({note}, '') = ''"
        parts += [_select("more", f"{item} = 1 AND {blank}", _content([item, note]), f"{item}_開放題未填"),
                  _select("more", f"{item} IS DISTINCT FROM 1 AND NOT ({blank})", _content([item, note]),
                          f"{item}_所選選項不應填答開放題")]
    return parts


def _work_parts():
    first = "(w1a1 = '' OR w1b1 IS NULL)"
    return [_select("more", first, _content(["w1a1", "w1b1"]), "w1_工作題開放欄位未填答"),
            _select("more", f"NOT {first} AND w2a1 = ''", _content(["w2a1"]), "w2_工作題開放欄位未填答")]


def _phone_parts():
    phones = ["cell1", "cell2", "phone1", "phone2"]
    parts = [_select("more", " AND ".join(f"{p} IN ('0', '-8')" for p in phones), _content(phones),
                     "完全沒有連絡電話或全拒答")]
    for p in phones:
        clean = f"regexp_replace({p}, '#|-|轉|分機|ext| ', '', 'g')"
        given, digits = f"{p} NOT IN ('0', '-8', '')", f"regexp_full_match({clean}, '[0-9]+')"
        if p.startswith("phone"):
            parts.append(_select("more", f"{given} AND NOT {digits}", _content([p]), f"{p}_號碼格式有誤，請確認"))
        else:
            parts += [_select("more", f"{given} AND LENGTH({clean}) < 10", _content([p]), f"{p}_號碼少於10碼"),
                      _select("more", f"{given} AND LENGTH({clean}) >= 10 AND NOT ({digits} AND {clean} LIKE '09%')",
                              _content([p]), f"{p}_號碼格式有誤，請確認")]
    return parts


def _filled_parts():
    """note1 belongs to m01 (the later rule), kc1 to opinion; kc2 is excluded by its item."""
    return [_select("more", f"wave = 'w01' AND TRIM(COALESCE({note}, '')) <> ''", _content([item, note]),
                    f"{note}_請確認答案是否可以歸類")
            for item, note in (("opinion", "kc1"), ("m01", "note1"), ("x3c1", "s2"))]


def _range_parts(times=1):
    score = _select("resp", "(score < 0 OR score > 90) AND score NOT IN (95, 99)", _content(["score"]), "score_數值不合理")
    code = _select("resp", "(c1 < 1 OR c1 > 20) AND c1 NOT IN (-8, -7)", _content(["c1"]), "c1_數值不合理")
    return [score] * times + [code]


_FOUND = f"found AS ({_union(_range_parts(2))})"
_KEPT = "wave <> 'w00' AND no <> 'n1'"

GAP_BODY = (
    "SELECT no, id, status, COALESCE(g1 > 10, FALSE) OR COALESCE(g2 > 10, FALSE) AS flag, "
    "CONCAT_WS('|', CASE WHEN g1 > 10 THEN 't1_ansTime = ' || strftime(t1, '%Y/%m/%d %H:%M:%S') || "
    "'，t2_ansTime = ' || strftime(t2, '%Y/%m/%d %H:%M:%S') END, "
    "CASE WHEN g2 > 10 THEN 't2_ansTime = ' || strftime(t2, '%Y/%m/%d %H:%M:%S') || "
    "'，t10_ansTime = ' || strftime(t3, '%Y/%m/%d %H:%M:%S') END) AS details, "
    "CAST((TRIM(t2_ansTime) <> '' AND t2 IS NULL) AS INT) AS unreadable FROM ("
    "SELECT *, epoch(t2) / 60 - epoch(t1) / 60 AS g1, epoch(t3) / 60 - epoch(t2) / 60 AS g2 FROM ("
    "SELECT *, TRY_CAST(t1_ansTime AS TIMESTAMP) AS t1, TRY_CAST(t2_ansTime AS TIMESTAMP) AS t2, "
    "TRY_CAST(t10_ansTime AS TIMESTAMP) AS t3 FROM resp WHERE status = '完訪: 100'))")

SQL = {
    "check_note": with_resp(_union(_note_parts() + _pair_parts() + _work_parts() + _phone_parts()
                                   + _filled_parts())),
    "check_single_note": with_resp(_union(_note_parts())),
    "check_multi_note": with_resp(_union(_pair_parts())),
    "check_work_note": with_resp(_union(_work_parts())),
    "check_phone_format": with_resp(_union(_phone_parts())),
    "check_filled_notes": with_resp(_union(_filled_parts())),
    "check_response_notes": with_resp(_select("resp", "note1 <> ''", _content(["note1"]), "請確認訪員回報的內容")),
    "check_range": with_resp(_union(_range_parts())),
    "check_range_events": "SELECT 'panel' AS survey, CAST(user_id AS VARCHAR) AS no, event_id AS id, "
                          "'value=' || CAST(value AS VARCHAR) AS content, 'value_數值不合理' AS reason, '' AS reply, "
                          "event_type AS wave, '' AS note FROM events WHERE value < 1 OR value > 120",
    "check_multi_response": with_resp(_select(
        "resp", "m01 + m02 + COALESCE(m03, 0) = 0", _content(["m01", "m02", "m03"]), "m_複選題全未勾選")),
    "check_skip": with_resp(_select("resp", "gender = 1 AND area IN (1, 3) AND (s1 <> -6 OR s2 <> '-6')",
                                    _content(["gender", "area", "s1", "s2"]), "should skip")),
    "check_skip2": with_resp(_union([
        _select("resp", "gender = 2 AND s1 = -6 AND s2 = '-6'", _content(["gender", "s1", "s2"]), "wrongly skipped"),
        _select("resp", "agegp = 5", _content(["agegp"]), "empty list")])),
    "check_logic": with_resp(_union([
        _select("more", "gender = 2 AND contains(who, '先生')", _content(["gender", "who"]), "L1_address does not fit"),
        _select("more", "NOT COALESCE(agegp + edugp < 7, FALSE)", _content(["agegp", "edugp"]), "L2_too much")])),
    "check_logic_python_forms": with_resp(_union([
        _select("more", "who LIKE '李%' AND gender <> 1", _content(["who"]), "P1_name"),
        _select("more", "m01 + m02 + COALESCE(m03, 0) > 1", _content(["m01", "m02", "m03"]), "P2_boxes"),
        _select("more", "NOT COALESCE(score BETWEEN 0 AND 100, FALSE) AND c1 NOT IN (-8, -7, -6, -5)", _content(["score"]), "P3_bounds"),
        _select("more", "agegp = edugp AND edugp = opinion", _content(["agegp"]), "P4_all alike"),
        _select("more", "who IS NOT NULL AND NOT (length(who) > 2 AND right(who, 2) = '先生')", _content(["id"]),
                "P5_no finding where the text is missing")])),
    "rule_failures": with_resp(
        "SELECT check_no, n AS rows, CASE check_no WHEN 'L1' THEN l1 WHEN 'P5' THEN p5 ELSE 0 END AS raised FROM "
        "(SELECT count(*) AS n, count(*) FILTER (gender = 2 AND who IS NULL) AS l1, count(*) FILTER (who IS NULL) AS p5 FROM more), "
        "(VALUES ('L1'), ('L2'), ('P1'), ('P2'), ('P3'), ('P4'), ('P5')) v(check_no)"),
    "time_gap_report": with_resp(GAP_BODY),
    "remove_handled": with_resp(f"SELECT * FROM found WHERE {_KEPT}", _FOUND),
    "remove_handled_all_copies": with_resp(
        f"SELECT * FROM found WHERE {_KEPT} AND reason <> 'score_數值不合理'", _FOUND),
    "event_gaps": "SELECT user_id, event_id, event_type, previous_event, round(micros / 6e7, 4) AS minutes FROM ("
                  "SELECT *, lag(event_id) OVER w AS previous_event, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros FROM events "
                  "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE micros / 6e7 > 600",
    "time_gap_slashes": with_resp(GAP_BODY),
    "check_range_open_bounds": with_resp(_union([
        _select("resp", "score > 90 AND score NOT IN (95, 99)", _content(["score"]), "score_數值不合理"),
        _select("resp", "c1 < 1 AND c1 NOT IN (-8, -7)", _content(["c1"]), "c1_數值不合理")])),
    "check_single_note_number": with_resp(_union([
        _select("more", "x3c1 = 1", "'x3c1=' || COALESCE(CAST(x3c1 AS VARCHAR), 'nan') || '，s2=' || "
                "CASE WHEN s2 = '-6' THEN '-6.0' ELSE 'nan' END", "x3c1_開放題未填")])),
    "findings_report_text_ids": with_resp(f"SELECT DISTINCT * FROM found WHERE {_KEPT}", _FOUND),
    "findings_report": with_resp(f"SELECT DISTINCT * FROM found WHERE {_KEPT}", _FOUND),
    "findings_report_key_table": with_resp(f"SELECT DISTINCT * FROM found WHERE {_KEPT}", _FOUND),
    "findings_report_initial": with_resp("SELECT DISTINCT * FROM found", _FOUND),
}
SQL.update({f"{name}_python": SQL[name] for name in ("check_skip", "check_skip2")})
# a Python rule raises for a missing text, and then finds nothing; the SQL rule of the same sheet is false there and TorF is T
SQL["check_logic_python"] = SQL["check_logic"]
