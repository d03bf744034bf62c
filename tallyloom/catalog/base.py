"""The survey view ``resp`` over ``orders`` and small helpers of the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RESP_SQL = """
SELECT
  o_orderkey AS id,
  CONCAT('n', CAST(o_custkey % 20 AS STRING)) AS no,
  CONCAT('w0', CAST(o_orderkey % 3 AS STRING)) AS wave,
  CASE WHEN o_orderkey % 10 = 0 THEN '中止: 200' ELSE '完訪: 100' END AS status,
  CAST(o_custkey % 2 + 1 AS INT) AS gender,
  CAST(o_custkey % 5 + 1 AS INT) AS agegp,
  CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 3 + 1 END AS INT) AS edugp,
  CAST(o_orderkey % 6 + 1 AS INT) AS area,
  CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 95
            WHEN o_orderkey % 13 = 0 THEN 98 ELSE o_orderkey % 4 + 1 END AS INT) AS supporting_party,
  CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey % 4 + 1 END AS INT) AS opinion,
  CAST(o_orderkey % 7 + 1 AS DOUBLE) / 4 AS wt,
  CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 101 END AS DOUBLE) AS score,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS m01,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS m02,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 8 = 0 THEN NULL ELSE 0 END AS INT) AS m03,
  CAST(o_orderkey % 30 - 9 AS INT) AS c1,
  CAST(CAST(FLOOR(CAST(o_orderkey AS DOUBLE) / 30) AS BIGINT) % 20 - 8 AS INT) AS c2,
  CAST(o_custkey % 9 - 7 AS INT) AS c3,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
       WHEN o_orderkey % 4 = 2 THEN ' 日本 ' ELSE '火星' END AS kc1,
  CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE CAST(o_orderkey % 18 AS STRING) END AS kc2,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN -6 ELSE o_orderkey % 3 + 1 END AS INT) AS s1,
  CASE WHEN o_orderkey % 5 = 0 THEN '-6' ELSE 'a' END AS s2,
  CASE WHEN o_orderkey % 8 = 0 THEN '0' WHEN o_orderkey % 8 = 1 THEN '-8'
       WHEN o_orderkey % 8 = 2 THEN '0912-345' ELSE '0912-345-678' END AS cell1,
  CASE WHEN o_orderkey % 8 < 2 THEN '0' ELSE '08123456789' END AS cell2,
  CASE WHEN o_orderkey % 8 < 3 THEN '0' ELSE '02-12345678#12' END AS phone1,
  CASE WHEN o_orderkey % 16 < 9 THEN '-8' ELSE 'none' END AS phone2,
  CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE 'job' END AS w1a1,
  CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE 'duty' END AS w1b1,
  CASE WHEN o_orderkey % 14 = 0 THEN '' ELSE 'job' END AS w2a1,
  CASE WHEN o_orderkey % 25 = 0 THEN 'call back' ELSE NULL END AS note1,
  '2024-01-01 10:00:00' AS t1_ansTime,
  CASE WHEN o_orderkey % 21 = 0 THEN 'bad'
       ELSE CONCAT('2024-01-01 10:', LPAD(CAST(o_orderkey % 25 AS STRING), 2, '0'), ':00') END AS t2_ansTime,
  '2024-01-01 10:30:00' AS t10_ansTime,
  CAST(o_custkey % 100 AS INT) AS a2y,
  CAST(o_orderkey % 12 + 1 AS INT) AS a2m,
  CAST((o_custkey % 12 + 1) * 100 + 15 AS INT) AS sdt1,
  CAST(100 + (o_custkey * 7) % 900 AS INT) AS zip,
  CAST(o_orderkey % 8 AS INT) AS household,
  CAST(o_custkey % 9 + 1 AS INT) AS sample_rule,
  CAST(o_orderkey % 4 + 1 AS INT) AS za2,
  CAST(o_custkey % 4 + 1 AS INT) AS zb4,
  CAST(CAST(FLOOR(CAST(o_orderkey AS DOUBLE) / 4) AS BIGINT) % 2 AS INT) AS zb604
FROM orders
"""

# more answers, for rules that the columns above do not reach
MORE_SQL = """
SELECT *,
  CAST(CAST(FLOOR(CAST(id AS DOUBLE) / 7) AS BIGINT) % 14 - 6 AS INT) AS wk,
  CASE WHEN id % 7 = 0 THEN -8 ELSE agegp END AS pl,
  CASE WHEN id % 31 = 0 THEN NULL ELSE c1 END AS ci,
  CAST(CASE WHEN id % 29 = 0 THEN NULL ELSE id % 180 - 9 END AS INT) AS hours,
  CAST(id % 1700 - 8 AS INT) AS occ,
  CAST(CAST(FLOOR(CAST(id AS DOUBLE) / 3) AS BIGINT) % 24 - 1 AS INT) AS lv,
  CASE WHEN id % 15 = 0 THEN -7 WHEN id % 16 = 0 THEN -8 ELSE a2y END AS birthy,
  agegp * 10 AS a2r,
  2025 AS year,
  area AS x3c1,
  CASE WHEN id % 5 = 0 THEN '王先生' WHEN id % 5 = 1 THEN '李太太'
       WHEN id % 5 = 2 THEN '本人' WHEN id % 5 = 3 THEN '朋友' ELSE NULL END AS who
FROM (SELECT * FROM resp) AS r
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESP_SQL.replace("FROM orders", "FROM {orders}"),
                     orders=table(spark, sf_dir, "orders"))


def more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MORE_SQL.replace("FROM resp", "FROM {resp}"), resp=resp(spark, sf_dir))


def with_resp(body: str, ctes: str = "") -> str:
    return f"WITH resp AS ({RESP_SQL}), more AS ({MORE_SQL}){', ' + ctes if ctes else ''}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema])
