"""Access to the driver's parquet tables and the shared ``dirty_orders`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# The messy input used by the audit / preparation / feature tests.  The same
# text runs in Spark SQL and in DuckDB; it keeps every order row and repeats
# one in a hundred to create exact duplicates.
DIRTY_ORDERS_SQL = """
WITH base AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 50 = 7 THEN 'bad'
         ELSE CAST(o_custkey AS STRING) END AS num_text,
    CASE WHEN o_orderkey % 25 = 0 THEN NULL WHEN o_orderkey % 90 = 11 THEN 'unknown'
         ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS date_text,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderpriority END AS category,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 5 THEN o_totalprice * 10
         ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_orderstatus END AS sparse,
    o_orderkey % 3 = 0 AS flag
  FROM {orders})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 100 = 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_ORDERS_SQL, orders=table(spark, sf_dir, "orders"))
