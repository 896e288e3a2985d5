"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deliveryrisk.functions.scalar import round_half_up
from deliveryrisk.sources.canonical import Tables

DIGITS = 4

# Canonical tables for the check SQL: ord, drv, cus, prd, mis, reg.
CANONICAL_SQL = """
WITH items AS (
  SELECT l_orderkey,
         COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS items_missing,
         COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS items_delivered
  FROM lineitem GROUP BY l_orderkey),
first_line AS (
  SELECT l_orderkey, l_suppkey FROM (
    SELECT l_orderkey, l_suppkey,
           ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem) WHERE rn = 1),
ord AS (
  SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date,
         o.o_totalprice AS order_amount, r.r_name AS region,
         COALESCE(i.items_delivered, 0) AS items_delivered,
         COALESCE(i.items_missing, 0) AS items_missing,
         CAST((o.o_orderkey * 7 + o.o_custkey) % 24 AS INTEGER) AS delivery_hour,
         COALESCE(f.l_suppkey, o.o_orderkey % (SELECT COUNT(*) FROM supplier)) AS driver_id,
         o.o_custkey AS customer_id
  FROM orders o
  LEFT JOIN items i ON i.l_orderkey = o.o_orderkey
  LEFT JOIN first_line f ON f.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
drv AS (
  SELECT s_suppkey AS driver_id, s_name AS driver_name, CAST(s_suppkey % 50 + 18 AS INTEGER) AS age,
         CAST(s_suppkey * 13 % 130 AS INTEGER) AS trips FROM supplier),
cus AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name,
         CAST(c_custkey % 63 + 18 AS INTEGER) AS customer_age FROM customer),
prd AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_retailprice AS price FROM part),
reg AS (SELECT r_regionkey AS region_id, r_name AS region_name FROM region),
mis AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS missing_item_id,
         l_orderkey AS order_id, l_partkey AS product_id, CAST(pos AS INTEGER) AS item_position
  FROM (SELECT l_orderkey, l_partkey,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
        FROM lineitem WHERE l_returnflag = 'R')),
facts AS (
  SELECT m.order_id, m.product_id, o.order_date, o.order_amount, o.region, o.items_delivered, o.items_missing,
         o.delivery_hour, o.driver_id, o.customer_id, p.product_name, p.category, p.price
  FROM mis m LEFT JOIN ord o USING (order_id) LEFT JOIN prd p USING (product_id))"""


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names its fractional columns, compared to four decimals."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql, tuple(doubles.split()))
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Round fractional columns half up; adding 0 turns a negative zero into zero."""
    return df.select(
        *[
            (round_half_up(f.name, DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: rounded(q.run(Tables(spark, path)))


def sql_round(value: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38, 8)), {digits}) AS DOUBLE)"


def oracle_text(q: Query) -> str:
    body = q.sql.strip()
    head, own = CANONICAL_SQL, body
    if body[:15].upper() == "WITH RECURSIVE ":
        head, own = head.replace("WITH ", "WITH RECURSIVE ", 1), f"WITH {body[15:]}"
    joined = head + (",\n" + own[5:] if own[:5].upper() == "WITH " else "\n" + own)
    replaced = ", ".join(f"{sql_round(c, DIGITS)} + 0.0 AS {c}" for c in q.doubles)
    star = f"* REPLACE ({replaced})" if replaced else "*"
    return f"SELECT {star} FROM (\n{joined}\n) AS q"


def sql_rate(missing: str, delivered: str) -> str:
    """Missing share of all items in percent, 0 without items."""
    return (
        f"(CASE WHEN ({missing}) + ({delivered}) > 0 "
        f"THEN CAST({missing} AS DOUBLE) / (({missing}) + ({delivered})) * 100.0 ELSE 0.0 END)"
    )
