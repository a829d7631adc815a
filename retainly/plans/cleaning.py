"""Cleaning and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from ..operators import clean as C
from ..operators import quality as Q
from ..operators.transactions import transaction_features
from ..sources import derived as D
from ..sources import views as V
from ..sources.views import ORDERS_AS_OF
from .registry import register
from .sqltext import oracle

LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _orders_out(df, amount="amount"):
    return df.select(as_long("order_id").alias("order_id"), as_long("customer_id").alias("customer_id"),
                     as_double(amount).alias("amount"), F.col("priority"))


@register("dedup_all_columns", "V2", oracle("""
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
FROM lineitem"""))
def q_dedup_all(t):
    d = C.drop_duplicates(t.lineitem)
    return d.select(*[F.col(c).cast("string").alias(c) if c == "l_shipdate" else
                      (as_long(c).alias(c) if c == "l_linenumber" else F.col(c)) for c in LI_COLS])


@register("dedup_line_keys", "V2", oracle("""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
           l_linestatus, l_shipdate) AS rn FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
FROM r WHERE rn = 1"""))
def q_dedup_keys(t):
    d = C.drop_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])
    return d.select(*[F.col(c).cast("string").alias(c) if c == "l_shipdate" else
                      (as_long(c).alias(c) if c == "l_linenumber" else F.col(c)) for c in LI_COLS])


_ORD_SEL = "CAST(order_id AS BIGINT) AS order_id, CAST(customer_id AS BIGINT) AS customer_id"


@register("fill_drop", "V3a", oracle(f"""
SELECT {_ORD_SEL}, ROUND(amount, 6) AS amount, priority FROM dirty WHERE amount IS NOT NULL""",
                                     dirty=D.DIRTY_ORDERS_SQL))
def q_fill_drop(t):
    return _orders_out(C.fill_drop(D.dirty_orders(t), ["amount"]))


@register("fill_mean", "V3b", oracle(f"""
SELECT {_ORD_SEL}, ROUND(COALESCE(amount, (SELECT AVG(amount) FROM dirty)), 6) AS amount, priority
FROM dirty""", dirty=D.DIRTY_ORDERS_SQL))
def q_fill_mean(t):
    return _orders_out(C.fill_mean(D.dirty_orders(t), ["amount"]))


@register("fill_zero", "V3c", oracle(f"""
SELECT {_ORD_SEL}, ROUND(COALESCE(amount, 0), 6) AS amount, priority FROM dirty""",
                                     dirty=D.DIRTY_ORDERS_SQL))
def q_fill_zero(t):
    return _orders_out(C.fill_zero(D.dirty_orders(t), ["amount"]))


@register("fill_forward", "V3d B7", oracle(f"""
SELECT {_ORD_SEL}, ROUND(last_value(amount IGNORE NULLS) OVER (PARTITION BY customer_id
  ORDER BY order_date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS amount, priority
FROM dirty""", dirty=D.DIRTY_ORDERS_SQL))
def q_fill_forward(t):
    return _orders_out(C.fill_forward(D.dirty_orders(t), ["amount"], "customer_id", ["order_date", "order_id"]))


@register("fill_median", "V3e", oracle(f"""
SELECT {_ORD_SEL}, ROUND(COALESCE(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty)), 6) AS amount,
  priority FROM dirty""", dirty=D.DIRTY_ORDERS_SQL))
def q_fill_median(t):
    return _orders_out(C.fill_median(D.dirty_orders(t), ["amount"]))


@register("fill_mode_max", "V3f", oracle(f"""
SELECT {_ORD_SEL}, ROUND(COALESCE(amount, (SELECT MAX(amount) FROM dirty)), 6) AS amount,
  COALESCE(priority, (SELECT priority FROM dirty WHERE priority IS NOT NULL GROUP BY priority
                      ORDER BY COUNT(*) DESC, priority LIMIT 1)) AS priority
FROM dirty""", dirty=D.DIRTY_ORDERS_SQL))
def q_fill_mode_max(t):
    d = C.fill_mode(D.dirty_orders(t), ["priority"])
    return _orders_out(C.fill_max(d, ["amount"]))


@register("fill_by_family", "V3f", oracle(f"""
SELECT {_ORD_SEL}, ROUND(COALESCE(CAST(amount AS DOUBLE), (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.5) FROM dirty)), 6) AS amount,
  COALESCE(priority, (SELECT priority FROM dirty WHERE priority IS NOT NULL GROUP BY priority ORDER BY COUNT(*) DESC, priority LIMIT 1)) AS priority
FROM dirty""", dirty=D.DIRTY_ORDERS_SQL))
def q_fill_by_family(t):
    """Each family's rule: amounts take their 50th percentile, categories their mode."""
    return _orders_out(C.fill_by_family(D.dirty_orders(t), {"amount": 50, "priority": "mode"}))


@register("iqr_outliers_approx", "V4")
def q_iqr_approx(t):
    d = C.remove_outliers_iqr(D.balances_with_outlier(t), "balance", rel_error=0.05)
    return d.select(as_long("customer_id").alias("customer_id"), as_double("balance").alias("balance"))


@register("zscore_outliers", "V5", oracle("""
WITH s AS (SELECT AVG(balance) AS m, STDDEV_SAMP(balance) AS sd FROM b)
SELECT CAST(customer_id AS BIGINT) AS customer_id, ROUND(balance, 6) AS balance
FROM b, s WHERE ABS(balance - m) / sd <= 3.0""", b=D.BALANCES_SQL))
def q_zscore(t):
    d = C.remove_outliers_zscore(D.balances_with_outlier(t), "balance", 3.0)
    return d.select(as_long("customer_id").alias("customer_id"), as_double("balance").alias("balance"))


def _etl_customers(t):
    ltv = V.transactions(t, lines=False).groupBy("customer_id") \
        .agg(F.sum("order_amount").cast("double").alias("lifetime_value"))
    c = V.customers(t).select("customer_id", F.datediff(F.lit(ORDERS_AS_OF).cast("date"),
                                                          F.to_date("signup_date")).alias("account_age_days"))
    return c.join(ltv, "customer_id", "left")


@register("clean_customers", "V6 V3e V3c", oracle(f"""
WITH e AS (
  SELECT c.customer_id, date_diff('day', CAST(c.signup_date AS DATE), DATE '{ORDERS_AS_OF[:10]}') AS account_age_days,
    l.ltv AS lifetime_value
  FROM customers c LEFT JOIN (SELECT customer_id, CAST(SUM(order_amount) AS DOUBLE) AS ltv
                              FROM transactions GROUP BY customer_id) l ON l.customer_id = c.customer_id),
f AS (SELECT customer_id, COALESCE(account_age_days, (SELECT quantile_cont(account_age_days, 0.5) FROM e)) AS account_age_days,
        COALESCE(lifetime_value, 0) AS lifetime_value FROM e),
q AS (SELECT quantile_cont(lifetime_value, 0.25) AS q1, quantile_cont(lifetime_value, 0.75) AS q3 FROM f)
SELECT CAST(customer_id AS BIGINT) AS customer_id, ROUND(account_age_days, 6) AS account_age_days,
  ROUND(lifetime_value, 6) AS lifetime_value
FROM f, q WHERE lifetime_value >= q1 - 1.5 * (q3 - q1) AND lifetime_value <= q3 + 1.5 * (q3 - q1)""",
                                            ["customers", "transactions"]))
def q_clean_customers(t):
    d = C.clean_customers(_etl_customers(t))
    return d.select(as_long("customer_id").alias("customer_id"), as_double("account_age_days").alias("account_age_days"),
                    as_double("lifetime_value").alias("lifetime_value"))


@register("clean_transactions", "V7 V8 V9", oracle("""
WITH p AS (SELECT * FROM e WHERE amount > 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, amount, transaction_date ORDER BY transaction_id) AS rn FROM p)
SELECT CAST(transaction_id AS BIGINT) AS transaction_id, CAST(customer_id AS BIGINT) AS customer_id,
  ROUND(amount, 6) AS amount, CAST(transaction_date AS VARCHAR) AS transaction_date FROM r WHERE rn = 1""",
                                                 e=D.ETL_TRANSACTIONS_SQL))
def q_clean_transactions(t):
    d = C.clean_transactions(D.etl_transactions(t).withColumn(
        "transaction_date", F.to_timestamp(F.col("transaction_date").cast("string"))))
    return d.select(as_long("transaction_id").alias("transaction_id"), as_long("customer_id").alias("customer_id"),
                    as_double("amount").alias("amount"),
                    F.col("transaction_date").cast("timestamp_ntz").cast("string").alias("transaction_date"))


@register("near_duplicate_transactions", "V9b B8", oracle("""
WITH r AS (SELECT *, LAG(transaction_date) OVER (PARTITION BY customer_id, amount
             ORDER BY transaction_date, transaction_id) AS prev FROM e)
SELECT CAST(transaction_id AS BIGINT) AS transaction_id, CAST(customer_id AS BIGINT) AS customer_id,
  ROUND(amount, 6) AS amount, CAST(transaction_date AS VARCHAR) AS transaction_date
FROM r WHERE prev IS NULL OR epoch(transaction_date) - epoch(prev) > 60""", e=D.ETL_TRANSACTIONS_SQL))
def q_near_dups(t):
    d = C.drop_near_duplicates(D.etl_transactions(t), 60)
    return d.select(as_long("transaction_id").alias("transaction_id"), as_long("customer_id").alias("customer_id"),
                    as_double("amount").alias("amount"),
                    F.col("transaction_date").cast("string").alias("transaction_date"))


# DuckDB type names -> Spark's simple type strings (the V12 rows name Spark types).
SPARK_TYPE = ("CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
              "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({t}) END")


def _integrity_sql():
    nulls = []
    for c in LI_COLS:
        nulls.append(f"SELECT 'nulls' AS check, '{c}' AS column_name, 'count' AS measure, "
                     f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS value FROM d")
        nulls.append(f"SELECT 'nulls', '{c}', 'pct', ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) * 100, 6) FROM d")
        nulls.append(f"SELECT 'types', '{c}', {SPARK_TYPE.format(t=f'ANY_VALUE(typeof({c}))')}, "
                     f"CAST(COUNT({c}) AS DOUBLE) FROM d")
    cols = ", ".join(LI_COLS)
    return "\n UNION ALL ".join([
        "SELECT 'table' AS check, '*' AS column_name, 'rows' AS measure, CAST(COUNT(*) AS DOUBLE) AS value FROM d",
        f"SELECT 'table', '*', 'columns', {float(len(LI_COLS))}",
        f"SELECT 'duplicates', '*', 'count', CAST(COALESCE(SUM(n - 1), 0) AS DOUBLE) FROM (SELECT COUNT(*) AS n FROM d GROUP BY {cols})",
        f"SELECT 'duplicates', '*', 'pct', ROUND(CAST(COALESCE(SUM(n - 1), 0) AS DOUBLE) / SUM(n) * 100, 6) FROM (SELECT COUNT(*) AS n FROM d GROUP BY {cols})",
        *nulls,
        "SELECT 'date_range', 'l_shipdate', 'min', CAST(epoch(MIN(l_shipdate)) AS DOUBLE) FROM d",
        "SELECT 'date_range', 'l_shipdate', 'max', CAST(epoch(MAX(l_shipdate)) AS DOUBLE) FROM d",
        "SELECT 'schema', 'l_orderkey', 'present', 1.0", "SELECT 'schema', 'l_shipdate', 'present', 1.0",
        "SELECT 'schema', 'l_comment', 'present', 0.0"])


@register("integrity_report", "V1 V10 V11 V12 V13", oracle(_integrity_sql(), d=D.DIRTY_LINEITEM_SQL))
def q_integrity(t):
    return Q.integrity_report(D.dirty_lineitem(t), required=["l_orderkey", "l_shipdate", "l_comment"])


RANGE_RULES = [("l_discount", 0.0, 0.1), ("l_quantity", 1.0, 50.0), ("l_tax", 0.0, 0.08)]


@register("range_assertions", "V14", oracle("\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
    f"CAST(COUNT(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS out_of_range, "
    f"CAST(COUNT(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 AS BIGINT) AS passed FROM lineitem"
    for c, lo, hi in RANGE_RULES)))
def q_range(t):
    return Q.range_assertions(t.lineitem, RANGE_RULES)


GATE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quality_gates", "V15", oracle("\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 6) AS null_share, "
    f"CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, "
    f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) > 0.05 AS BIGINT) AS null_gate_failed, "
    f"CAST(COALESCE(MIN({c}) = MAX({c}), TRUE) AS BIGINT) AS constant_gate_failed FROM d" for c in GATE_COLS),
    d=D.DIRTY_LINEITEM_SQL))
def q_gates(t):
    return Q.quality_gates(D.dirty_lineitem(t), GATE_COLS)


def _tf_sql():
    from ..operators.transactions import transaction_features_sql
    return transaction_features_sql(ORDERS_AS_OF)


@register("feature_caps", "V16", oracle(f"""
SELECT tf.customer_id, CAST(LEAST(days_since_last_purchase, 15000) AS BIGINT) AS days_since_last_purchase,
  ROUND(LEAST(lifetime_purchase_value, 100000), 6) AS total_spend, CAST(LEAST(COALESCE(s.n, 0), 1000) AS BIGINT) AS support_tickets
FROM tf LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM support_tickets GROUP BY customer_id) s ON s.customer_id = tf.customer_id""",
                                     ["transactions", "support_tickets"], tf=_tf_sql()))
def q_caps(t):
    f = transaction_features(V.transactions(t), ORDERS_AS_OF) \
        .select("customer_id", "days_since_last_purchase", F.col("lifetime_purchase_value").alias("total_spend"))
    tickets = V.support_tickets(t).groupBy("customer_id").agg(F.count(F.lit(1)).alias("support_tickets"))
    capped = Q.apply_caps(f.join(tickets, "customer_id", "left").fillna(0, subset=["support_tickets"]), Q.FEATURE_CAPS)
    return capped.select("customer_id", as_long("days_since_last_purchase").alias("days_since_last_purchase"),
                         as_double("total_spend").alias("total_spend"), as_long("support_tickets").alias("support_tickets"))


Z_COLS = ["lifetime_purchase_value", "total_orders", "average_order_value", "days_since_last_purchase",
          "purchase_frequency"]


@register("zscore_outlier_flag", "V18 Q5 Q8", oracle("""
WITH s AS (SELECT """ + ", ".join(f"AVG({c}) AS m{i}, STDDEV_POP({c}) AS s{i}" for i, c in enumerate(Z_COLS)) + """ FROM tf)
SELECT customer_id, CAST(CASE WHEN """ + " OR ".join(
    f"COALESCE(s{i} > 0 AND ABS({c} - m{i}) / s{i} > 3.0, FALSE)" for i, c in enumerate(Z_COLS)) + """
  THEN 1 ELSE 0 END AS BIGINT) AS is_outlier FROM tf, s""", ["transactions"], tf=_tf_sql()))
def q_zflag(t):
    f = transaction_features(V.transactions(t), ORDERS_AS_OF)
    return Q.zscore_outlier_flag(f, Z_COLS, 3.0).select("customer_id", "is_outlier")


@register("feature_statistics", "V19", oracle("\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS count, "
    f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, ROUND(AVG({c}), 6) AS mean, "
    f"ROUND(STDDEV_SAMP({c}), 6) AS std, ROUND(MIN({c}), 6) AS min, "
    f"ROUND(quantile_cont({c}, 0.25), 6) AS q25, ROUND(quantile_cont({c}, 0.5), 6) AS q50, "
    f"ROUND(quantile_cont({c}, 0.75), 6) AS q75, ROUND(MAX({c}), 6) AS max FROM tf" for c in Z_COLS),
    ["transactions"], tf=_tf_sql()))
def q_stats(t):
    f = transaction_features(V.transactions(t), ORDERS_AS_OF)
    return Q.feature_statistics(f, Z_COLS)
