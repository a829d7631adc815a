"""Derived inputs for cleaning / drift checks (FIXTURES.md §4), built from the
driver tables by fixed rules so their size grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def dirty_orders(t: Tables) -> DataFrame:
    """orders with NULL amounts (orderkey % 7 = 0) and NULL priorities (% 11 = 0)."""
    o = t.orders
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("order_date"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"),
                    F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
                    F.col("o_orderstatus").alias("status"))


DIRTY_ORDERS_SQL = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus AS status
FROM orders"""


def dirty_lineitem(t: Tables) -> DataFrame:
    """lineitem with NULL discounts where l_orderkey % 7 = 0 (real key duplicates kept)."""
    li = t.lineitem
    return li.select(*[F.when(F.col("l_orderkey") % 7 != 0, F.col(c)).alias(c) if c == "l_discount"
                       else F.col(c) for c in li.columns])


DIRTY_LINEITEM_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem"""


def balances_with_outlier(t: Tables) -> DataFrame:
    """customer balances plus one extreme row (1e9) for outlier removal."""
    c = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    extra = c.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("customer_id"),
                                           F.lit(1e9).alias("balance"))
    return c.unionByName(extra)


BALANCES_SQL = """
SELECT c_custkey AS customer_id, c_acctbal AS balance FROM customer
UNION ALL SELECT -1 AS customer_id, 1e9 AS balance"""


def etl_transactions(t: Tables) -> DataFrame:
    """ETL-side transactions (customer_id, amount, transaction_date) from orders."""
    return t.orders.select(F.col("o_orderkey").alias("transaction_id"),
                           F.col("o_custkey").alias("customer_id"),
                           F.col("o_totalprice").alias("amount"),
                           F.col("o_orderdate").alias("transaction_date"))


ETL_TRANSACTIONS_SQL = """
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount,
  o_orderdate AS transaction_date FROM orders"""


def derived_ctes(**named_sql: str) -> str:
    return ",\n".join(f"{k} AS ({v.strip()})" for k, v in named_sql.items())


DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DRIFT_CUT = "1998-01-01 00:00:00"


def drift_pair(t: Tables):
    """(reference, current) feature frames from lineitem: shipped before / from
    1998-01-01; the current side's extended price is scaled by 1.3."""
    li = t.lineitem
    cut = F.lit(DRIFT_CUT).cast("timestamp_ntz")
    ref = li.filter(F.col("l_shipdate") < cut).select(*DRIFT_FEATURES)
    cur = li.filter(F.col("l_shipdate") >= cut).select(
        "l_quantity", (F.col("l_extendedprice") * 1.3).alias("l_extendedprice"), "l_discount", "l_tax")
    return ref, cur


DRIFT_REF_SQL = f"SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate < TIMESTAMP '{DRIFT_CUT}'"
DRIFT_CUR_SQL = (f"SELECT l_quantity, l_extendedprice * 1.3 AS l_extendedprice, l_discount, l_tax FROM lineitem "
                 f"WHERE l_shipdate >= TIMESTAMP '{DRIFT_CUT}'")
