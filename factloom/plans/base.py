"""Registration of queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Trade between nations over selected lines: who buys from whom.
TRADE_SQL = """trade AS (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE l.l_quantity >= 50 AND l.l_discount >= 0.09
)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst): nation of the customer, nation of the supplier, of large lines at a high discount."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey as src")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey as dst")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select("src", "dst")
