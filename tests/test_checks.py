import random

from pyspark.sql import functions as F

from tallyloom.operators import checks as C


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, f"n{i}", "w01", *r) for i, r in enumerate(rows, 1)],
                                 "id long, no string, wave string, " + schema)


def reasons(df):
    return sorted((r["id"], r["content"], r["reason"]) for r in df.collect())


def test_single_note_branches(spark):
    df = frame(spark, [(9, None), (9, " 　"), (9, "text"), (1, "text"), (1, ""), (None, "text"),
                       (8, "text")], "q int, kq string")
    rules = [{"ori_item": "q", "note_item": "kq", "value": 9, "add_output": "no@absent"},
             {"ori_item": "q", "note_item": "kq", "value": 8, "add_output": None}]
    got = reasons(C.check_single_note(df, rules))
    assert (1, "q=9，kq=nan，no=n1", "q_開放題未填") in got
    assert (2, "q=9，kq= 　，no=n2", "q_開放題未填") in got
    extra = {(i, r) for i, _, r in got if r.endswith("所選選項不應填答開放題")}
    assert {i for i, _ in extra} == {4, 6}  # a NULL answer is no allowed answer
    assert not [g for g in got if g[0] in (3, 5, 7)]


def test_skipped_code_is_blank_for_x3c_only(spark):
    df = frame(spark, [(1, "-6")], "x3c1 int, k1 string")
    rules = [{"ori_item": "x3c1", "note_item": "k1", "value": 1, "add_output": None},
             {"ori_item": "q", "note_item": "k1", "value": 1, "add_output": None}]
    df = df.withColumn("q", F.lit(1))
    assert [r[2] for r in reasons(C.check_single_note(df, rules))] == ["x3c1_開放題未填"]


def test_missing_rule_columns_are_reported(spark):
    errors = []
    df = frame(spark, [(1,)], "q int")
    rules = [{"ori_item": "q", "note_item": "nope", "value": 1, "add_output": None}]
    assert C.check_single_note(df, rules, errors=errors).count() == 0
    assert len(errors) == 1


def test_multi_note_is_untrimmed(spark):
    df = frame(spark, [(1, " "), (1, ""), (0, " "), (None, "x"), (0, None)], "m int, k string")
    got = [(i, r) for i, _, r in reasons(C.check_multi_note(df, [("m", "k")]))]
    assert got == [(2, "m_開放題未填"), (3, "m_所選選項不應填答開放題"), (4, "m_所選選項不應填答開放題")]


def test_only_first_work_block(spark):
    df = frame(spark, [("", "x", ""), ("x", "x", None), ("x", "x", "x")], "w1a1 string, w1b3 string, w2a1 string")
    assert [(i, c) for i, c, _ in reasons(C.check_work_note(df, ["w1", "w2"]))] == [
        (1, "w1a1=，w1b3=x"), (2, "w2a1=nan")]


def test_phones(spark):
    df = frame(spark, [("0", "-8", "0", "0"), ("0912345678", "0", "02-1234轉5分機6ext7#8", "-8"),
                       ("091234", "0812345678", "12a", None), ("09１２345678", "09123456789x", "", " 123 "),
                       (None, "-8", "-8", "-8")],
               "cell1 string, cell2 string, phone1 string, phone2 string")
    got = reasons(C.check_phone_format(df))
    assert [(i, r) for i, _, r in got] == [
        (1, "完全沒有連絡電話或全拒答"),
        (3, "cell1_號碼少於10碼"), (3, "cell2_號碼格式有誤，請確認"),
        (3, "phone1_號碼格式有誤，請確認"), (3, "phone2_號碼格式有誤，請確認"),
        (4, "cell2_號碼格式有誤，請確認"),
        (5, "cell1_號碼少於10碼")]
    assert (3, "phone2=nan", "phone2_號碼格式有誤，請確認") in got  # a missing number is malformed


def test_filled_notes(spark):
    df = frame(spark, [("a", "b", "c", "d")], "k1 string, xk string, email string, k2 string")
    df = df.withColumn("q1", F.lit(1)).withColumn("q2", F.lit(2))
    rules = [{"note_item": n, "ori_item": "q1"} for n in ("k1", "xk", "email", "k2")]
    multi = [{"note_item": "k1", "ori_item": "q2"}, {"note_item": "k2", "ori_item": "connect"}]
    got = reasons(C.check_filled_notes(df, rules, multi, "w01"))
    assert [c for _, c, _ in got] == ["q1=1，k2=d", "q2=2，k1=a"]
    assert C.check_filled_notes(df, rules, multi, "w02").count() == 0
    assert C.check_filled_notes(df, rules, multi, None, note_exclude=["k1", "k2"]).count() == 0


def test_range(spark):
    df = frame(spark, [(0.0,), (1.0,), (10.5,), (99.0,), (None,)], "v double")
    rules = [{"var": "v", "min": 1.0, "max": 10.0, "special_code": "98@99"},
             {"var": "v", "min": None, "max": 0.5, "special_code": None},
             {"var": "gone", "min": 0.0, "max": 1.0, "special_code": None}]
    got = [(i, c) for i, c, _ in reasons(C.check_range(df, rules))]
    assert got == [(1, "v=0.0"), (2, "v=1.0"), (3, "v=10.5"), (3, "v=10.5"), (4, "v=99.0")]


def test_multi_response(spark):
    df = frame(spark, [(0, None), (1, 0), (None, None)], "m01 int, m02 int")
    assert [i for i, _, _ in reasons(C.check_multi_response(df, [{"muti_item": "m", "max": 2}]))] == [1, 3]


def test_skip_both_ways(spark):
    rule = {"triggerA": "a", "triggerB": "", "condition": "a = 1", "description": "d", "output": "a@n@gone",
            "skip_num": "n", "skip_str": "s@gone"}
    df = frame(spark, [(1, -6, "-6"), (1, 3, "-6"), (1, None, "-6"), (2, 3, "x"), (1, 3, "x"), (None, 1, "x")],
               "a int, n int, s string")
    assert [i for i, _, _ in reasons(C.check_skip(df, [rule]))] == [2, 3, 5]
    assert reasons(C.check_skip2(df, [rule])) == [(1, "a=1，n=-6", "d")]
    empty = dict(rule, skip_num=None, skip_str="")
    assert C.check_skip(df, [empty]).count() == 0
    assert [i for i, _, _ in reasons(C.check_skip2(df, [empty]))] == [1, 2, 3, 5]
    errors = []
    bad = [dict(rule, condition="a ="), dict(rule, condition="nowhere = 1"), dict(rule, condition="a + 1")]
    assert C.check_skip(df, [*bad, rule], errors=errors).count() == 3
    assert len(errors) == 3


def test_rule_words_leave_quoted_text_alone(spark):
    df = frame(spark, [("a", "it1 a"), ("b", "x")], "x string, y string")
    rules = [{"check_no": 1, "var_list": "x@y", "check_rule": "it1 = 'a'\nAND it2 LIKE 'it1 %'", "TorF": "T",
              "description": "d", "out_var": "x"}]
    assert reasons(C.check_logic(df, rules)) == [(1, "x=a", "1_d")]


def test_logic_keywords_and_expected_false(spark):
    df = frame(spark, [("陳先生",), ("陳小姐",), (None,)], "who string")
    rule = {"check_no": "L", "var_list": "who", "check_rule": "exists(male_appellation, k -> contains(it1, k))",
            "TorF": "T", "description": "d", "out_var": "who"}
    assert [i for i, _, _ in reasons(C.check_logic(df, [rule]))] == [1]
    assert [i for i, _, _ in reasons(C.check_logic(df, [dict(rule, TorF="F")]))] == [2, 3]
    assert [i for i, _, _ in reasons(C.check_logic(df, [rule], {"male": ["姐"]}))] == [2]


def test_many_rules_in_one_scan(spark):
    df = frame(spark, [(5,), (50,)], "v int")
    rules = [{"var": "v", "min": 0.0, "max": float(i), "special_code": None} for i in range(300)]
    assert C.check_range(df, rules).count() == 5 + 50
    assert C.findings(df, []).count() == 0


def test_time_gaps(spark):
    t = "2024-01-01 10:{}"
    df = frame(spark, [
        ("完訪: 100", t.format("00:00"), t.format("10:00"), t.format("20:00.5")),
        ("完訪: 100", t.format("00:00"), "bad", t.format("59:00")),
        ("完訪: 100", t.format("30:00"), t.format("00:00"), None),
        ("中止: 200", t.format("00:00"), t.format("50:00"), None)],
        "status string, t2_ansTime string, t10_ansTime string, t11_ansTime string")
    df = df.withColumn("record_ansTime", F.lit("2030-01-01 00:00:00"))
    out = {r["id"]: r for r in C.time_gap_report(df.select("t11_ansTime", *[c for c in df.columns if c != "t11_ansTime"])).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1]["details"] == ["t10_ansTime = 2024/01/01 10:10:00，t11_ansTime = 2024/01/01 10:20:00"]
    assert not out[2]["flag"] and not out[3]["flag"] and out[3]["details"] == []


def test_time_forms(spark):
    forms = {"2024-03-04 05:06:07": True, "2024/3/4 5:06:07": True, "2024/03/04  5:06": False, "20240304050607": True, " 2024-03-04T05:06:07　": True,
             "2024/3/4": False, "3/4/2024 5:06:07": True, "03/04/2024 05:06": False, "3/4/2024": False, "13/4/2024 5:06": None, "2024/13/4": None,
             "noon": None, "": None, "2024/3/4 x": None}
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    got = {r["t"]: r["m"] and str(r["m"]) for r in df.select("t", C._time(F.col("t"), False).alias("m")).collect()}
    for text, full in forms.items():
        clock = "05:06:07" if full else "05:06:00" if ":06" in text else "00:00:00"
        assert got[text] == (None if full is None else f"2024-03-04 {clock}"), text
    day = {r["t"]: r["m"] and str(r["m"]) for r in df.select("t", C._time(F.col("t"), True).alias("m")).collect()}
    assert day["3/4/2024 5:06:07"] == "2024-04-03 05:06:07" and day["13/4/2024 5:06"] == "2024-04-13 05:06:00"
    assert {t for t in forms if got[t] != day[t]} == {"3/4/2024 5:06:07", "03/04/2024 05:06", "3/4/2024", "13/4/2024 5:06"}
    done = df.selectExpr("1 AS no", "1 AS id", f"'{C.COMPLETED}' AS status", "t AS a_ansTime", "'4/04/2024 1:00' AS b_ansTime")
    assert [tuple(r) for r in C.ambiguous_times(done).collect()] == [("a_ansTime", 3), ("b_ansTime", 0)]


FOUND = "survey string, no string, id long, content string, reason string, reply string, wave string, note string"


def test_report_drops_handled_and_copies(spark):
    row = lambda i, c, no="n1", wave="02": ("s", no, i, c, "r", "", wave, "")
    now = spark.createDataFrame([row(1, "a"), row(1, "a", wave="01"), row(2, "b"), row(3, "c", no=None)], FOUND)
    past = spark.createDataFrame([("n1", "2", "b", "r", "ok"), (None, "3", "c", "r", "ok")],
                                 "no string, id string, content string, reason string, reply string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    once = C.findings_report(now, past, "02")
    assert ids(once) == [1] and once.columns == now.columns and once.first()["wave"] == "01"
    assert ids(C.findings_report(once, past, "02")) == [1]
    assert ids(C.findings_report(now, past, "01")) == [1, 2, 3]
    assert ids(C.findings_report(now, past, "02", drop_all_copies=True)) == []
    assert ids(C.remove_handled(now, past)) == [1, 1]
    assert ids(C.remove_handled(now, past, drop_all_copies=True)) == []


def test_range_rules_as_data(spark, monkeypatch):
    """Thousands of rules in one scan, and the same findings as by an expression each."""
    rng = random.Random(3)
    cols = [f"v{k}" for k in range(1200)]
    kinds = ["int", "double", "string"]
    data = [[rng.choice([None, 0, 1, 5, -8, 99, 250]) for _ in cols] for _ in range(12)]
    typed = [[None if x is None else (int(x), float(x), rng.choice([str(x), "x", f"{x}.5"]))[k % 3] for k, x in enumerate(row)] for row in data]
    df = frame(spark, typed, ", ".join(f"{c} {kinds[k % 3]}" for k, c in enumerate(cols)))
    rules = [{"var": rng.choice([*cols, "absent"]), "min": rng.choice([None, 1.0, 0.5]), "max": rng.choice([None, 90.0, 99.0]),
              "special_code": rng.choice([None, "-8", "-8@99", "95"])} for _ in range(5000)]
    many = C.check_range(df, rules)
    assert many._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    few = rules[:90]
    want = reasons(C.check_range(df, few))
    monkeypatch.setattr(C, "RULES_AS_DATA", 0)
    assert reasons(C.check_range(df, few)) == want != []
    assert reasons(C.findings(df, [*C.range_checks(df, few), *C.multi_response_checks(df, [{"muti_item": "absent", "max": 1}], [])])) == want

    def plain(row, r):
        if r["var"] not in cols or (x := row[cols.index(r["var"])]) is None:
            return False
        try:
            x = float(x)
        except ValueError:
            return False
        out = (r["min"] is not None and x < r["min"]) or (r["max"] is not None and x > r["max"])
        return out and x not in [float(s) for s in (r["special_code"] or "").split("@") if s]

    assert len(reasons(many)) == sum(plain(row, r) for row in typed for r in rules) > 5000


def test_phones_seen_as_good_at_once_and_cleaned_ones_agree(spark):
    rng = random.Random(4)
    parts = ["0", "9", "09", "12345678", "-", "#", "轉", "分", "機", "分機", "e", "ext", " ", "１", "a", "\t", "0912345678", "0912-345-678"]
    rows = [tuple("".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(4)) for _ in range(600)]
    df = frame(spark, rows, "cell1 string, cell2 string, phone1 string, phone2 string")

    def want(name, text):
        text = text.strip()
        if text in ("0", "-8", ""):
            return None
        digits = text
        for part in ("#", "-", "轉", "分機", "ext", " "):
            digits = digits.replace(part, "")
        digits = digits.strip()
        if name.startswith("phone"):
            return None if digits.isdigit() else "號碼格式有誤，請確認"
        if len(digits) < 10:
            return "號碼少於10碼"
        return None if digits.isdigit() and digits.startswith("09") else "號碼格式有誤，請確認"

    got = {(i, r) for i, _, r in reasons(C.check_phone_format(df)) if not r.startswith("完全")}
    assert got == {(i, f"{n}_{w}") for i, row in enumerate(rows, 1) for n, t in zip(C.PHONES, row) if (w := want(n, t))}
