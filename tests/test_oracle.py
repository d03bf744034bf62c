"""Every registered query against its SQL."""
import pytest

import __spark_entry__ as entry
from tallyloom import catalog
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert name in entry.oracle_sql()
    diff, _, _ = compare(spark, con, name, SF)
    assert diff in ("", "empty result"), diff


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["row_kind"] for r in rows] == ["valid"] * 3 + ["total"]
    assert rows[-1]["percentage"] == 100.0
