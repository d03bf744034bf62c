"""Compare registered queries with their SQL on DuckDB."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if v is None or isinstance(v, (str, bool)):
        return v
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, float]:
    """('' or what differs, seconds in Spark, seconds in DuckDB)"""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    mine = _table(df.columns, df.collect())
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "", t1 - t0, 0.0
    cur = con.execute(sql)
    other = _table([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if mine[0] != other[0]:
        return f"columns {mine[0]} vs {other[0]}", t1 - t0, t2 - t1
    if len(mine[1]) != len(other[1]):
        return f"rows {len(mine[1])} vs {len(other[1])}", t1 - t0, t2 - t1
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return f"{mine[0]}: {a} vs {b}", t1 - t0, t2 - t1
    return "" if mine[1] else "empty result", t1 - t0, t2 - t1


if __name__ == "__main__":
    from conftest import session
    sf = sys.argv[1]
    spark, con, bad = session(), connect(sf), 0
    for q in sys.argv[2:] or entry.queries():
        try:
            diff, a, b = compare(spark, con, q, sf)
        except Exception as e:  # report and go on
            diff, a, b = f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {q:28s} {a:6.2f}s {b:6.2f}s {diff}", flush=True)
    print("failures:", bad)
