"""Rules in Python syntax against Python itself, row by row."""
import math
import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import checks as C
from tallyloom.plans import pyrules as P

WORDS = ["先生", "太太", "a", ""]
SCHEMA = "i long, j long, x double, y double, s string, t string"


def rows(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "a", "ab", " ab ", "王先生", "12", "-3", "x1", "2.5", "ABC"]
    nums = [None, 0.0, 1.0, -2.5, 3.0, 7.0, 100.0]
    return [(rng.randrange(-4, 8), rng.choice([0, 1, 2, -3]), rng.choice(nums), rng.choice(nums), rng.choice(texts), rng.choice(texts))
            for _ in range(n)]


def as_python(row):
    """The values of a data frame: whole numbers, floats with NaN, texts with NaN."""
    i, j, x, y, s, t = row
    num = lambda v: np.float64(math.nan if v is None else v)
    txt = lambda v: math.nan if v is None else v
    return {"i": np.int64(i), "j": np.int64(j), "x": num(x), "y": num(y), "s": txt(s), "t": txt(t)}


def verdict(rule, row):
    """True, False or 'raises' as a condition, and whether it equals True and False."""
    env = {"words": WORDS, "pd": pd, "np": np, "none": None, **as_python(row)}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            value = eval(" ".join(rule.split("\n")), env)
            return bool(value), bool(value == True), bool(value == False)  # noqa: E712
        except Exception:
            return "raises", False, False


RULES = [
    "i == 1", "i != x", "x != x", "x == x", "i < x", "x >= 3", "not x > 1", "i", "x", "s", "not s", "x and i == 1", "i == 1 and x", "s or i",
    "i == 1 and j in [1, 2]", "i in (1, 2) or x in {3, 7.0}", "i not in [1, 2]", "x not in [1, 2]", "s in ['a', 'ab']", "s not in ['a']",
    "s == 1", "s != 1", "s == '12'", "i == '1'", "s < 'b'", "s < t", "s <= 5", "x < s", "none == 1", "none is None", "i is None", "none < 1", "s is not None",
    "any(k in s for k in words)", "all(k in s for k in words)", "any(k in s for k in words if k)", "any(k == s for k in words)",
    "i == 2 and any(k in s for k in words)", "isinstance(s, str) and any(k in s for k in words)", "isinstance(s, float)", "isinstance(x, float)",
    "isinstance(s, (str, float))", "len(s) > 1", "isinstance(s, str) and len(s) > 1", "len(words) == 4", "len([k for k in words if k in s]) > 1",
    "i + j < 3", "x + i > 2", "x * y - 1 >= 0", "i / j > 1", "x / y < 0", "x // 2 == 1", "i // 3 == -1", "i % 3 == 2", "i % j == 0", "x % 3 > 1", "-i > 2", "+x > 2",
    "x // y > 1", "i // j < 0", "abs(x) > 2", "abs(i) == 3",
    "0 <= i <= 3", "0 < i < x < 10", "i == j == 1", "1 if x > 2 else i", "(s if i > 2 else t) == 'a'", "(s if i > 2 else x) == 'a'", "(x or 1) == 1",
    "(s or 'z') == 'z'", "(i and s) == 'a'", "(i if x > 0 else 2.5) > 2",
    "str(i) == '1'", "str(x) == '3.0'", "str(s) == 'nan'", "len(str(i)) == 2", "int(x) == -2", "int(s) > 3", "float(s) > 2", "int(s) if s.isdigit() else 0",
    "isinstance(s, str) and s.isdigit() and int(s) == 12", "s.strip() == 'ab'", "s.lower() == 'abc'", "s.upper() == 'AB'", "s.startswith('a')",
    "s.startswith(('a', ' '))", "s.endswith(t)", "s.replace('a', '') == 'b'", "i.strip() == ''", "s[0] == 'a'", "s[-1] == '生'", "s[:1] == 'a'", "s[1:] == 'b'",
    "s[-2:] == '先生'", "s[:-1] == 'a'", "s[1:3] == 'b '", "s[5] == 'a'", "s + t == 'aab'", "i + s == 3", "words[0] in s", "s in 'xab'", "x in s", "s in t",
    "sum([i, j]) > 2", "sum([x, y, i]) > 2", "sum(1 for v in [i, j, x] if v > 0) >= 2", "sum(v for v in [i, j, x] if v == v) > 2", "len(set([i, j])) == 1",
    "len(set([i, j, x])) == 2", "len({i, 1, 2}) == 2", "any([i == 1, x == 1])", "all([i, j])", "any([])", "all([])", "all(v > 0 for v in (i, j, x))",
    "any(a == b for a in [i, j] for b in [1, 2])", "any(k in s for k in words + ['x'])", "pd.isna(x)", "pd.notna(s) and len(s) == 2", "np.isnan(x)",
    "True", "False", "None", "0", "1", "2", "''", "'a'", "1.0", "i == True", "bool(x)", "bool(s) == False", "not (i == 1 or x > 2) and not s",
    "i == 1 and\n x == 3", "i > 99999999999999999999", "i == 1 or len(s) > 1", "i != 1 and len(s) > 1 or x == 3", "len(s) > 1 or i == 1", "len(list(words)) == 4"]


def test_against_python(spark):
    data = rows(400, 5)
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(data)], "n long, " + SCHEMA)
    names = {c: P.column(df, c) for c in ("i", "j", "x", "y", "s", "t")} | {"words": P.words(WORDS), "none": P.constant(None)}
    wrong = []
    for start in range(0, len(RULES), 25):
        part = RULES[start:start + 25]
        compiled = [P.compile_rule(r, names) for r in part]
        out = df.select("n", *[F.struct(P.holds(v).alias("h"), P.answers(v, True).alias("t"), P.answers(v, False).alias("f"),
                                        P.raising(v).alias("r")).alias(f"c{k}") for k, v in enumerate(compiled)])
        for got in out.collect():
            for k, rule in enumerate(part):
                want = verdict(rule, data[got["n"]])
                here = got[f"c{k}"]
                mine = ("raises" if here["r"] else here["h"], here["t"], here["f"])
                if mine != want:
                    wrong.append((rule, data[got["n"]], mine, want))
    assert not wrong, f"{len(wrong)} differ: {wrong[:5]}"


@pytest.mark.parametrize("rule", [
    "__import__('os').system('true')", "open('x')", "lambda: 1", "(lambda k: k)(i)", "i.__class__", "s.format(i)", "[k for k in s]", "f'{i}'", "(k := 1)",
    "i if", "i = 1", "import os", "", "unknown == 1", "i ** 9", "i << 1", "~i", "s[i]", "s[::2]", "{1: 2}", "any(*words)", "len(words, i)", "len(obj=s)",
    "isinstance(i, object)", "eval('1')", "getattr(s, 'x')", "i is 1", "words == words", "await i", "[*words]", "(" * 500 + "i" + ")" * 500, "1j", "b'x' == s",
    "any(a for a, b in words)", "s.encode()", "...", "i\x00"])
def test_what_is_not_compiled(spark, rule):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, "a", "b")], SCHEMA)
    with pytest.raises(P.RuleError):
        P.compile_rule(rule, {c: P.column(df, c) for c in ("i", "s")} | {"words": P.words(WORDS)})


def test_whole_numbers_are_int(spark):
    df = spark.createDataFrame([(1, 1.0, None), (None, None, "a")], "i int, x double, s string")
    names = {c: P.column(df, c) for c in df.columns}
    got = df.select(*[P.holds(P.compile_rule(r, names)).alias(r) for r in ("isinstance(i, int)", "isinstance(i, float)", "isinstance(x, (int, str))",
                                                                          "isinstance(s, float)")]).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (False, True, False, False)]


def test_long_rules_stay_small(spark):
    """Many words, and many alternatives, make a plan in proportion."""
    df = spark.createDataFrame([("x499", 7)], "s string, i int")
    names = {"s": P.column(df, "s"), "i": P.column(df, "i"), "words": P.words([f"x{k}" for k in range(500)])}
    for rule in ("any(k in s for k in words)", "all(not k == s[1:] for k in words)", " or ".join(f"i == {k}" for k in range(300)),
                 " and ".join(f"len(s) != {k}" for k in range(50, 200))):
        value = P.compile_rule(rule, names)
        assert len(df.select(P.holds(value).alias("h"))._jdf.queryExecution().analyzed().toString()) < 400_000
        assert df.select(P.holds(value).alias("h")).first()["h"] is True


def test_checks_in_both_languages(spark):
    df = spark.createDataFrame([(1, "n1", "w", 1, 3, 5, "x"), (2, "n1", "w", 1, None, -6, "-6"), (3, "n1", "w", 2, 1, 1, None), (4, "n1", "w", 1, 1, None, "-6")],
                               "id long, no string, wave string, a1 int, b1 int, s1 int, who string")
    sql = [{"triggerA": "a1", "triggerB": "b1", "condition": "a = 1 AND b IN (1, 3)", "description": "d", "output": "a1@b1", "skip_num": "s1", "skip_str": "who"}]
    python = [{**sql[0], "condition": "a == 1 and b in [1, 3]"}]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(C.check_skip(df, sql)) == key(C.check_skip(df, python, language="python")) != []
    mixed = [sql[0], {**python[0], "language": "python"}]
    assert len(key(C.check_skip(df, mixed))) == 2 * len(key(C.check_skip(df, sql)))
    errors = []
    bad = [{**python[0], "condition": "open(a)"}, {**python[0], "condition": "a < 'x'"}, {**python[0], "condition": "b.c"}]
    assert C.check_skip(df, bad, errors=errors, language="python").count() == 0 and len(errors) == 3
    logic = [{"check_no": "1", "var_list": "who", "TorF": t, "out_var": "who", "check_rule": "len(it1) == 1", "description": "d"} for t in "TF"]
    assert [r["id"] for r in C.check_logic(df, logic, language="python").orderBy("id").collect()] == [1, 2, 4]  # not 3: it raises
    assert [tuple(r) for r in C.rule_failures(df, logic).collect()] == [("1", 4, 1), ("1", 4, 1)]
    assert C.rule_failures(df, []).count() == 0
