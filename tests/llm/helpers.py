"""Small tables of odd rows, shared by the tests."""
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, score string, spans string, ids string, n_words int, leaks int, verdict string"


def docs(spark, rows):
    """``documents`` of (id, text), with columns whose names the operators also use."""
    full = [(i, t, "en", "x", "y", "z", -1, -1, "w") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "same words here in this line of text"),
       (5, "same words here in this line of text"), (None, "a row without an id, but with a text of its own"),
       (7, "long " * 20_000), (8, "x" * 90_000), (9, "1" * 50_000 + "@" * 10 + "." * 10)]


def check_odd(spark, operator, rows=len(ODD)):
    """The operator keeps its rows over odd and over no rows."""
    out = operator(docs(spark, ODD))
    assert out.count() == rows
    empty = operator(docs(spark, []))
    assert empty.count() == 0 and empty.columns == out.columns
    assert len(set(out.columns)) == len(out.columns)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["DOCS", "F", "ODD", "by_id", "check_odd", "docs", "plan"]
