from tallyloom.operators import checks as C
from tallyloom.operators import recode as R


def test_row_local_operators_on_a_stream(spark, tmp_path):
    schema = "id long, no string, wave string, v int, x int"
    rows = [(1, "n", "w", 50, 9), (2, "n", "w", 1, 3)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rules = [{"var": "v", "min": 0.0, "max": 10.0, "special_code": None}]
    recoded = R.recode_relig(stream, {"X": "x"}, "X")
    for name, df in (("found", C.check_range(stream, rules)), ("recoded", recoded)):
        q = df.writeStream.format("memory").queryName(name).option(
            "checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r["id"] for r in spark.sql("SELECT id FROM found").collect()] == [1]
    assert sorted(r["X"] for r in spark.sql("SELECT X FROM recoded").collect()) == [0, 2]
