"""Dirty tables derived from the clean ones by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _money(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS STRING)"


def _padded(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


_DAY = f"concat({_padded('day(o_orderdate)', 2)}, '/', {_padded('month(o_orderdate)', 2)}, '/', CAST(year(o_orderdate) AS STRING))"
_ISO = f"concat(CAST(year(o_orderdate) AS STRING), '-', {_padded('month(o_orderdate)', 2)}, '-', {_padded('day(o_orderdate)', 2)})"

ORDERS = f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN concat('($', {_money('o_totalprice')}, ')')
    WHEN o_orderkey % 13 = 0 THEN 'FREE' WHEN o_orderkey % 17 = 0 THEN concat(CAST(CAST(o_totalprice / 1000 AS DECIMAL(18,1)) AS STRING), 'K')
    ELSE concat(' $', {_money('o_totalprice')}) END AS order_value,
  CASE WHEN o_orderkey % 6 = 0 THEN '-' WHEN o_orderkey % 5 = 0 THEN concat('0.', {_padded('o_orderkey % 100', 2)})
    WHEN o_orderkey % 4 = 0 THEN CAST(2 + o_orderkey % 60 AS STRING) ELSE concat(CAST(o_orderkey % 60 AS STRING), '%') END AS discount_pct,
  CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN {_DAY} WHEN o_orderkey % 4 = 1 THEN {_ISO}
    WHEN o_orderkey % 4 = 2 THEN CAST(1577836800 + 3600 * o_orderkey AS STRING) ELSE CAST(40000 + o_orderkey % 5000 AS STRING) END AS order_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'Y' WHEN 1 THEN 'No' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN ' yes ' WHEN 5 THEN 'maybe' WHEN 6 THEN 'f' END AS is_returned,
  CASE o_orderkey % 4 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN concat(o_orderpriority, ' ') WHEN 2 THEN lower(o_orderpriority) ELSE 'n/a' END AS priority,
  concat('000', CAST(o_orderkey AS STRING)) AS ticket_code FROM orders"""

CUSTOMERS = f"""SELECT c_custkey AS customer_id, c_name AS full_name,
  CASE c_custkey % 3 WHEN 0 THEN concat('+91-', CAST(9000000000 + c_custkey AS STRING)) WHEN 1 THEN CAST(9000000000 + c_custkey AS STRING)
    ELSE concat('(987) 654-', {_padded('c_custkey % 10000', 4)}) END AS phone_number,
  concat({_padded('1 + c_custkey % 12', 2)}, '/', {_padded('1 + c_custkey % 11', 2)}, '/2021') AS signup_date,
  CASE WHEN c_acctbal < 0 THEN concat('($', {_money('-c_acctbal')}, ')')
    ELSE concat(CASE c_custkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '£' ELSE '€' END, {_money('c_acctbal')}) END AS account_balance,
  CASE c_custkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'F' WHEN 2 THEN 'yes' ELSE 'unknown' END AS is_active,
  concat('EMP', {_padded('c_custkey', 5)}) AS rep_key, {_padded('c_nationkey', 4)} AS nation_code,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 2 = 0 THEN concat(' ', lower(c_mktsegment)) ELSE lower(c_mktsegment) END AS tier FROM customer"""

PARTS = f"""SELECT p_partkey AS product_id,
  concat(CAST(1 + p_partkey % 9 AS STRING), '.', {_padded('p_partkey % 1000', 3)}, ',', {_padded('p_partkey % 100', 2)}, ' €') AS price_eu,
  CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_partkey % 100 AS STRING), '%') WHEN 1 THEN concat('0.', {_padded('p_partkey % 100', 2)})
    ELSE CAST(2 + p_partkey % 90 AS STRING) END AS margin_pct,
  {_padded('p_size', 5)} AS card_code, concat(CAST(p_size AS STRING), '.5') AS weight_txt FROM part"""

SQL = {"messy_orders": (ORDERS, "orders"), "messy_customer": (CUSTOMERS, "customer"), "messy_part": (PARTS, "part")}


def messy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection as a plan over the Parquet scan; no view is registered."""
    sql, table = SQL[name]
    return spark.sql(sql.replace(f" FROM {table}", " FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(name: str) -> str:
    return f"WITH {name} AS ({SQL[name][0]}) "
