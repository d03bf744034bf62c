import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import clean_nan
from tallyloom.functions.transcode import transcode_lossy
from tallyloom.operators import lookup as L
from tallyloom.operators.codebook import codebook, codebook_of, missing_codes, open_ranges, statements_of_lines
from tallyloom.plans import small
from tallyloom.sources import readers, writers

SYNTAX = '''* a comment.
VARIABLE LABELS q1 "First question"
  q2 "second"
 /q3 "third".
COMMENT TO q2: asked by phone
   only in wave 2
VALUE LABELS
q1 1 "yes" 2 "no"
  -8 "refused"
/q2
  1 "a" 1 "b".
MISSING VALUES q1 (1 thru 3, -9, x, 7 THRU 5).
FORMATS q1 (F2.0)
EXECUTE.
'''


def test_codebook(spark):
    df = spark.createDataFrame([("f", SYNTAX), ("g", SYNTAX.replace("\n", "\r\n")), ("h", "nothing here")],
                               "file string, text string")
    out = codebook(df).collect()
    assert [(r["file"], r["var"]) for r in out] == [(f, v) for f in "fg" for v in ("q1", "q2", "q3")]
    for q1, q2, q3 in (out[:3], out[3:]):
        assert q1["label"] == "First question" and q1["format"] == "F2.0"
        assert q1["value_labels"] == {1: "yes", 2: "no", -8: "refused"}
        assert q1["missing"] == [(1, 3), (-9, -9)]
        assert q2["comment"] == "asked by phone only in wave 2" and q2["value_labels"] == {1: "b"}
        assert q3["label"] == "third" and q3["format"] == "F8.0" and q3["missing"] == [] and q3["comment"] == ""


GRAMMAR = '''variable  labels a 'it''s' b "say ""x""" / c.1 "third" /d "".
Value Labels a b 1 'one' 2 "two" / c.1 -1 'x' b 2 "zwei"
  3 "drei".
MISSING VALUES a b (LO thru 0, 9) / c.1 (5 6 thru hi, 1 thru 100000000).
formats a b (F3.1) c.1 (A8).
COMMENT TO nobody
'''


def test_codebook_grammar(spark):
    out = codebook(spark.createDataFrame([("f", GRAMMAR), ("g", None)], "file string, text string")).collect()
    book = {r["var"]: r for r in out}
    assert list(book) == ["a", "b", "c.1"]
    assert [book[v]["label"] for v in book] == ["it's", 'say "x"', "third"]
    assert book["a"]["value_labels"] == {1: "one", 2: "two"} and book["c.1"]["value_labels"] == {-1: "x"}
    assert book["b"]["value_labels"] == {1: "one", 2: "zwei", 3: "drei"}
    assert book["a"]["missing"] == book["b"]["missing"] == [(None, 0), (9, 9)]
    assert book["c.1"]["missing"] == [(5, 5), (6, None), (1, 100000000)]
    assert [book[v]["format"] for v in book] == ["F3.1", "F3.1", "A8"]


def test_open_ranges_have_no_codes(spark):
    book = codebook(spark.createDataFrame([("f", "MISSING VALUES q (LO thru 0, 9, 5 THRU HIGHEST, lowest thru hi, HI thru 3, 4 thru LO, LO, HI)."),
                                           ("f", "x")], "file string, text string"))
    assert book.first()["missing"] == [(None, 0), (9, 9), (5, None), (None, None)]
    assert [r["code"] for r in missing_codes(book).collect()] == [9]
    assert sorted((r["lo"], r["hi"]) for r in open_ranges(book).where("lo is not null or hi is not null").collect() if r["lo"]) == [(5, None)]
    assert open_ranges(book).count() == 3


def plain_coded_labels(body):
    """The grammar of coded labels, token by token."""
    token = re.compile(r'"(?:[^"]|"")*"|' + r"'(?:[^']|'')*'" + r"|[^\W\d][\w.@#$]*(?<!\.)|[@#$][\w.@#$]*(?<!\.)|-?\d+(?:\.\d+)?|[/().,:]")
    names, opened, code, out = [], True, None, {}
    for t in token.findall(body):
        if t[0] in "\"'":
            text = t[1:-1].replace(t[0] * 2, t[0])
            if code is not None and text:
                out.update({(n, code): text for n in names})
            opened, code = False, None
            continue
        if re.match(r"[^\W\d]|[@#$]", t):
            names = [*names, t] if opened else [t]
            opened = True
        elif t == "/":
            names, opened = [], True
        code = int(t) if re.fullmatch(r"-?\d+", t) and abs(int(t)) < 2 ** 31 else None
    return out


def test_coded_labels_against_a_plain_reading(spark):
    rng = random.Random(2)
    parts = ["a", "b.1", "@c", "_d", "é", "1", "2", "-3", "a", "é", "1 'u'", "2 \"v\"", "-3 'w'", "1 'o' 2 't'", "1.5", "99999999999", '"x"', "'it''s'", '"say ""y"""', '""', "/", "(", ")", ",", ".", ":", "\n", "?", "-"]
    bodies = ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\t"]) for _ in range(rng.randrange(25))) for _ in range(400)]
    files = spark.createDataFrame([(str(k), "VALUE LABELS " + b) for k, b in enumerate(bodies)], "file string, text string")
    got = {}
    for r in codebook(files).collect():
        got.update({(int(r["file"]), r["var"], c): t for c, t in r["value_labels"].items()})
    assert got == {(k, n, c): t for k, b in enumerate(bodies) for (n, c), t in plain_coded_labels(b).items()}
    assert len(got) > 400


def test_long_statements_take_time_in_proportion(spark):
    def seconds(labels):
        text = "VALUE LABELS q1 q2\n" + "".join(f'{k} "label ""{k}"" of it"\n' for k in range(labels)) + ".\nVARIABLE LABELS q1 \"" + "x" * 200_000 + '".'
        files = spark.createDataFrame([("f", text)], "file string, text string")
        start = time.time()
        out = codebook(files).collect()
        assert [len(r["value_labels"]) for r in out] == [labels] * 2 and out[0]["value_labels"][1] == 'label "1" of it'
        assert len(out[0]["label"]) == 200_000
        return time.time() - start

    seconds(2000)
    assert seconds(64_000) < 4 * max(1, seconds(32_000))


def test_files_in_several_blocks(spark, tmp_path):
    """Statements that begin in one block and end in another, and blocks without any start."""
    rng = random.Random(5)
    for name in ("a.sps", "b.sps", "c.txt"):
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            for k in range(150):
                brk = rng.choice(["\n", "\r\n"])
                f.write(SYNTAX.replace("q1", f"é{k % 40}").replace("q2", f"q{k}_2").replace("First", "First " + "long " * rng.randrange(200)).replace("\n", brk))
    (tmp_path / "empty.sps").write_text("")
    whole = codebook(readers.read_syntax_files(spark, str(tmp_path))).collect()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = readers.read_syntax_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 100 and lines.rdd.getNumPartitions() > 50
        cut = codebook_of(statements_of_lines(lines)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert cut == whole and {r["file"] for r in cut} == {"a.sps", "b.sps"}


def test_syntax_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The same rows as Spark's own reader gives, without a scan that lists all files on the driver."""
    texts = {"a b%20é.sps": b"x\r\ny", "bad.sps": b"\xff\xfe", "empty.sps": b"", ".hidden.sps": b"h", "_no.sps": b"n", "c.txt": b"t", "dsps": b"d", "e.sps": b"\n"}
    for folder in ("", "k=1", "k=2"):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        for name, text in texts.items():
            (tmp_path / "in" / folder / name).write_bytes(text)
    (tmp_path / "in" / "other").mkdir()
    (tmp_path / "in" / "other" / "f.sps").write_bytes(b"f")
    for folder, copies in ((tmp_path / "in" / "k=1", 1), (tmp_path / "in", 3)):
        got = readers.read_syntax_files(spark, str(folder))
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["file"], bytes(r["text"])) for r in got.select("file", F.col("text").cast("binary").alias("text")).collect())
        assert rows == sorted((n.replace("%", "%25").replace(" ", "%20"), texts[n]) for n in ("a b%20é.sps", "bad.sps", "e.sps") for _ in range(copies))
    scan = readers.read_syntax_files(spark, str(tmp_path / "in" / "k=1"), "[a-z]*.sps")  # Spark's reader
    assert "FileScan" in scan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["file"] for r in scan.collect()) == ["a%20b%2520é.sps", "bad.sps", "e.sps"]


def test_a_file_for_every_text_written_by_all_tasks(spark, tmp_path):
    rows = [(f"text {k}\n",) for k in range(200)] + [(None,), ("",), ("same",), ("same",)]
    path = str(tmp_path / "texts")
    writers.write_text_files(spark.createDataFrame(rows, "text string").coalesce(1), path, per_folder=10)
    files = [f for f in (tmp_path / "texts").rglob("*.txt")]
    assert len(files) == len(rows) and len({f.parent.name.split("-")[0] for f in files}) == 8
    back = readers.read_syntax_files(spark, path, "*.txt")
    assert sorted(r["text"] for r in back.collect()) == sorted((t or "") + "\n" for t, in rows)


def test_texts_of_a_codebook_are_made_by_all_tasks(spark, tmp_path):
    from tallyloom.catalog import files
    spark.createDataFrame([(k, f"n{k}", "seg", k % 25) for k in range(400)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int"
                          ).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    texts = files._syntax(spark, str(tmp_path))
    assert len(texts.groupBy(F.spark_partition_id()).count().collect()) == 8 and texts.count() == 400


def test_missing_codes_of_a_long_range(spark):
    book = codebook(spark.createDataFrame([("f", "MISSING VALUES q (1 thru 3000000, 7)."), ("f2", "FORMATS q (F1).")], "file string, text string"))
    assert missing_codes(book).selectExpr("count(*)", "max(code)").first()[:] == (3_000_001, 3_000_000)


def test_many_words_keep_their_order(spark):
    text = "VARIABLE LABELS " + " ".join(f'v{k} "{k}"' for k in range(3000)) + ".\nVALUE LABELS v1 1 'a'.\nVALUE LABELS v1 1 'b'."
    out = codebook(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert [r["var"] for r in out] == [f"v{k}" for k in range(3000)] and out[1]["value_labels"] == {1: "b"}


def test_rules_round_trip(spark, tmp_path):
    path = str(tmp_path / "logic.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('check_no,var_list,check_rule,TorF,description,out_var\n1,a@b,"it1 = ""x""\nAND it2 = 1",T,d,a\n')
    row = readers.read_rules(spark, {"logic": path})["logic"].first()
    assert row["check_rule"] == 'it1 = "x"\nAND it2 = 1'
    with pytest.raises(ValueError):
        readers.read_rules(spark, {"nope": path})


def test_handled_reports_by_name(spark, tmp_path):
    head = "no,id,content,reason,reply\n"
    for folder, name in (("w01_檢誤報表", "s1_問卷檢誤_w01_0101_lee"), ("w01_檢誤報表", "s1_問卷檢誤_w01_0101_lee+done ok"),
                         ("w01_檢誤報表", "s1_問卷檢誤_w02_0101_lee"), ("w02_檢誤報表", "s1_問卷檢誤_w02_0101_kim"),
                         ("w02_檢誤報表", "s1_問卷檢誤_w02_x_lee"), ("other", "s1_問卷檢誤_w01_0101_lee")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.csv").write_text(head + f'n1,1,"a\r\r\nb",{folder}/{name},ok\n', encoding="utf-8", newline="")
    got = readers.read_handled_reports(spark, str(tmp_path), "s1", "lee")
    assert sorted(r["reason"] for r in got.collect()) == [
        "w01_檢誤報表/s1_問卷檢誤_w01_0101_lee", "w01_檢誤報表/s1_問卷檢誤_w01_0101_lee+done ok"]
    assert {r["content"] for r in got.collect()} == {"a\nb"}


def test_many_reports_are_one_scan(spark, tmp_path):
    for k in range(60):
        folder = tmp_path / f"w{k:02d}_檢誤報表"
        folder.mkdir()
        (folder / f"s_問卷檢誤_w{k:02d}_1_lee.csv").write_text(f'no,id,content,reason,reply,more\nn,{k},"a\nb",r,"",x\n', encoding="utf-8")
    got = readers.read_handled_reports(spark, str(tmp_path), "s", "lee")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    rows = sorted(("n", str(k), "a\nb", "r", "") for k in range(60))
    assert sorted(tuple(r) for r in got.collect()) == rows
    for k in (3, 4):  # another order is another scan, by name all the same
        (tmp_path / f"w{k:02d}_檢誤報表" / f"s_問卷檢誤_w{k:02d}_1_lee.csv").write_text(f'id,"no",reply,reason,content\n{k},n,"",r,"a\nb"\n', encoding="utf-8")
    again = readers.read_handled_reports(spark, str(tmp_path), "s", "lee")
    assert again._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(tuple(r) for r in again.collect()) == rows
    (tmp_path / "w03_檢誤報表" / "s_問卷檢誤_w03_1_lee.csv").write_text("no,id,content,reason\n")
    with pytest.raises(ValueError, match="no column"):
        readers.read_handled_reports(spark, str(tmp_path), "s", "lee")


def test_findings_are_partitioned(spark, tmp_path):
    found = spark.createDataFrame([("s", "n", 1, "c", "r", "", "w01", ""), ("s", "n", 2, "c", "r", "", "w02", "")],
                                  "survey string, no string, id long, content string, reason string, reply string, wave string, note string")
    writers.write_findings(found, str(tmp_path / "f"), "s1")
    writers.write_findings(found, str(tmp_path / "f"), "s2")
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 4 and back.filter("survey_code = 's1' AND wave = 'w02'").first()["id"] == 2


def test_multi_search(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 6, None), (2, 7, "é")], "id long, a int, b string")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a"), (2, "zz"), (2, "b")], "id long, item string")
    got = sorted(map(repr, (tuple(r) for r in L.multi_search(df, pairs, "ascii").collect())))
    assert got == sorted(map(repr, [(1, "a", "5", "5"), (1, "a", "6", "6"), (1, "b", "x", "x"), (1, "b", None, None),
                                    (2, "b", "é", "?"), (2, "b", "é", "?"), (2, "zz", None, None), (3, "a", None, None)]))


def test_transcode(spark):
    df = spark.createDataFrame([("台é",), (None,)], "t string")
    assert [r[0] for r in df.select(transcode_lossy(F.col("t"), "big5")).collect()] == ["台?", None]
    with pytest.raises(LookupError):
        transcode_lossy(F.col("t"), "no-such-charset")


def test_clean_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, x double")
    assert [r["x"] for r in clean_nan(df).collect()] == [None, 1.0]


def test_scratch_goes_with_its_block(spark):
    with small.scratch(spark.range(5), "test") as df:
        path = df.inputFiles()[0]
        assert df.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_tables_are_read_by_name_and_strictly(spark, tmp_path):
    def table(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    shuffled = table("a.csv", 'remark,special_code,max,var,min\n"x\ny",-8@-7,90,v1,0\n,"",,v2,\n')
    rows = readers.read_rules(spark, {"range": shuffled})["range"].collect()
    assert [tuple(r) for r in rows] == [("v1", 0.0, 90.0, "-8@-7"), ("v2", None, None, "")]
    with pytest.raises(ValueError, match="no column"):
        readers.read_rules(spark, {"range": table("b.csv", "var,min,max\nv,1,2\n")})
    with pytest.raises(Exception, match="min is no double: zero"):
        readers.read_rules(spark, {"range": table("c.csv", "var,min,max,special_code\nv,zero,2,\n")})["range"].collect()


def test_no_report_yet(spark, tmp_path):
    none = readers.read_handled_reports(spark, str(tmp_path), "a[1]*", "{lee}")
    assert none.count() == 0 and none.columns == ["no", "id", "content", "reason", "reply"]


def test_findings_in_csv_keep_line_breaks(spark, tmp_path):
    rows = [("s", "n", 1, 'text="a"\nb', "r", "", "01", None), ("s", "n", 2, "x", "r", None, "02", "")]
    found = spark.createDataFrame(rows, "survey string, no string, id long, content string, reason string, reply string, "
                                        "wave string, note string")
    for _ in range(2):
        writers.write_findings(found, str(tmp_path / "f"), "panel", fmt="csv")
    writers.write_findings(found.filter("wave = '02'"), str(tmp_path / "f"), "panel", fmt="csv")
    back = readers.read_findings(spark, str(tmp_path / "f"), fmt="csv")
    assert sorted(tuple(r) for r in back.select(*found.columns).collect()) == rows
    assert {r["survey_code"] for r in back.collect()} == {"panel"}


def test_query_and_literal(spark):
    df = spark.createDataFrame([(1, "a?"), (2, "b")], "id int, t string")
    assert L.query(df, 2, "t").collect()[0][0] == "b"
    assert [r[0] for r in L.find_literal(df, "t").collect()] == [1]


def test_materialized_files_go_when_told(spark):
    df = small.materialize(spark.range(5), "test")
    assert df.count() == 5 and small.clear_written(spark) >= 1 and small.clear_written(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(df.inputFiles()[0])


def test_a_local_warehouse_is_no_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/tmp/w"}.get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local[4]"

            @staticmethod
            def getCheckpointDir():
                return None

    assert small.shared_folder(Session()) == "file:/tmp/w"
    Session.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        small.shared_folder(Session())
