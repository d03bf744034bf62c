"""The shape of the physical plans: what is shuffled, read and reused."""
import re

import pytest

import __spark_entry__ as entry
from tallyloom import catalog
from tallyloom.operators import quantiles, stats

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["check_note", "check_range", "check_logic", "check_phone_format", "time_gap_report",
                                  "recode_education", "recode_work_spouse", "recode_region", "exclude_codes", "query"])
def test_row_local_work_is_not_shuffled(spark, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["household_design_weight", "rake", "rake_once"])
def test_lookups_are_broadcast(spark, name):
    shown = plan(entry.queries()[name](spark, SF))
    assert "BroadcastHashJoin" in shown and "Exchange hashpartitioning" not in shown


@pytest.mark.parametrize("name,columns", [("crosstab", {"l_returnflag", "l_linestatus"}),
                                          ("freq_table", {"l_returnflag", "l_quantity"}),
                                          ("main_crosstab_rolling", {"o_orderkey", "o_custkey"})])
def test_scans_read_only_what_is_used(spark, name, columns):
    shown = plan(entry.queries()[name](spark, SF))
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", shown):
        assert {c.split(":")[0] for c in read.split(",")} <= columns


@pytest.mark.parametrize("name", ["freq_table", "multi_freq", "oneway_anova", "crosstab_long", "weight_tables"])
def test_totals_reuse_the_exchange(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_join(spark, name):
    if name.startswith(("read_", "write_", "rake", "trim", "describe", "weight_desc")):
        pytest.skip("runs jobs while it is built")
    shown = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


@pytest.mark.parametrize("name", ["crosstab_weighted", "main_crosstab", "crosstab_categories"])
def test_wide_tables_read_the_data_once(spark, name):
    assert plan(entry.queries()[name](spark, SF)).count("FileScan") == 1


def jobs(spark, work) -> int:
    """How many Spark jobs ``work`` starts."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_share_their_passes(spark):
    df = spark.range(100_000).selectExpr("rand(1) AS a", "rand(2) * 1000 AS b", "id % 7 AS c")
    assert jobs(spark, lambda: stats.describe(df, ["a", "b", "c"]).collect()) <= 12
    more = jobs(spark, lambda: quantiles.exact_quantiles(df, ["a", "b", "c"], [k / 10 for k in range(11)]))
    assert more <= jobs(spark, lambda: quantiles.exact_quantiles(df, ["a"], [0.5])) + 2
