"""Per-customer transaction features (value, recency, frequency, windows).

All windows, recency and distinct counts come out of ONE hash aggregation
keyed on customer_id: a single shuffle of partially-aggregated rows, whatever
the number of windows. The window bound is `order_date >= as_of - N days`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long, days_between, since

DEFAULT_WINDOWS = (7, 30, 90)


def transaction_features(tx: DataFrame, as_of: str, windows=DEFAULT_WINDOWS,
                         missing_recency: int = 999) -> DataFrame:
    """lifetime value, order count, mean order, recency, frequency, windowed
    value/count, category diversity and refund rate — one row per customer
    with at least one transaction.

    tx: customer_id, order_date, order_amount (decimal), product_category, refund_flag.
    """
    amt = F.col("order_amount")
    win_aggs = []
    for w in windows:
        inside = F.col("order_date") >= since(as_of, w)
        win_aggs += [F.sum(F.when(inside, amt)).alias(f"_v{w}"),
                     F.count_if(inside).alias(f"_c{w}")]
    g = (tx.groupBy("customer_id")
         .agg(F.sum(amt).alias("_ltv"), F.count(F.lit(1)).alias("_n"),
              F.max("order_date").alias("_last"), F.min("order_date").alias("_first"),
              F.count_distinct("product_category").alias("_cats"),
              F.count_if(F.col("refund_flag") == 1).alias("_refunds"),
              *win_aggs))
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    ltv = F.col("_ltv").cast("double")
    cols = [as_long("customer_id").alias("customer_id"),
            as_double(ltv, None).alias("lifetime_purchase_value"),
            as_long("_n").alias("total_orders"),
            as_double(ltv / F.col("_n")).alias("average_order_value"),
            as_long(F.coalesce(days_between(as_of_c, "_last"), F.lit(missing_recency)))
            .alias("days_since_last_purchase"),
            as_double(F.col("_n") / (days_between(as_of_c, "_first") / 30.0 + 1))
            .alias("purchase_frequency")]
    for w in windows:
        cols += [as_double(F.coalesce(F.col(f"_v{w}").cast("double"), F.lit(0.0)), None)
                 .alias(f"purchase_value_{w}d"),
                 as_long(f"_c{w}").alias(f"order_count_{w}d")]
    cols += [as_long("_cats").alias("unique_categories"),
             as_double(F.col("_refunds") / F.col("_n")).alias("refund_rate")]
    return g.select(*cols)


def transaction_features_sql(as_of: str, windows=DEFAULT_WINDOWS) -> str:
    """Oracle text over the `transactions` view."""
    w_cols = ",\n  ".join(
        f"CAST(COALESCE(SUM(CASE WHEN order_date >= TIMESTAMP '{as_of}' - INTERVAL {w} DAY "
        f"THEN order_amount END), 0) AS DOUBLE) AS purchase_value_{w}d,\n  "
        f"CAST(COUNT(CASE WHEN order_date >= TIMESTAMP '{as_of}' - INTERVAL {w} DAY THEN 1 END) AS BIGINT)"
        f" AS order_count_{w}d" for w in windows)
    return f"""
SELECT CAST(customer_id AS BIGINT) AS customer_id,
  CAST(SUM(order_amount) AS DOUBLE) AS lifetime_purchase_value,
  CAST(COUNT(*) AS BIGINT) AS total_orders,
  ROUND(CAST(SUM(order_amount) AS DOUBLE) / COUNT(*), 6) AS average_order_value,
  CAST(date_diff('day', CAST(MAX(order_date) AS DATE), CAST(TIMESTAMP '{as_of}' AS DATE)) AS BIGINT)
    AS days_since_last_purchase,
  ROUND(COUNT(*) / (date_diff('day', CAST(MIN(order_date) AS DATE), CAST(TIMESTAMP '{as_of}' AS DATE)) / 30.0 + 1), 6)
    AS purchase_frequency,
  {w_cols},
  CAST(COUNT(DISTINCT product_category) AS BIGINT) AS unique_categories,
  ROUND(CAST(SUM(CASE WHEN refund_flag = 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS refund_rate
FROM transactions GROUP BY customer_id"""
