"""Feature-builder queries over the canonical views."""

from __future__ import annotations

from ..operators.transactions import transaction_features, transaction_features_sql
from ..sources import views as V
from ..sources.views import ORDERS_AS_OF, with_views
from .registry import register


@register("transaction_features", "F8 F9 F10 F11 F12 F13",
          with_views(transaction_features_sql(ORDERS_AS_OF), "transactions"))
def q_transaction_features(t):
    return transaction_features(V.transactions(t), ORDERS_AS_OF)


from pyspark.sql import functions as F  # noqa: E402

from ..functions.exprs import as_double, as_long  # noqa: E402
from ..operators.customer import (behavioral_features, engagement_features,  # noqa: E402
                                  period_rollup, profile_features, temporal_features)
from ..sources.views import EVENTS_AS_OF  # noqa: E402
from .sqltext import oracle  # noqa: E402

OA, EA = ORDERS_AS_OF, EVENTS_AS_OF


EXTRACT_ROWS = 10000  # fixed value: the extract is the newest 10000 active customers


@register("customer_extract", "S12 J5", oracle("""
SELECT CAST(customer_id AS BIGINT) AS customer_id, email, country, region,
  CAST(signup_date AS VARCHAR) AS signup_date, account_status, customer_segment, device_type, signup_source
FROM customers WHERE deleted_at IS NULL ORDER BY customer_id DESC LIMIT {EXTRACT_ROWS}""".replace("{EXTRACT_ROWS}", str(EXTRACT_ROWS)), ["customers"]))
def q_customer_extract(t, rows: int = EXTRACT_ROWS):
    c = V.customers(t).filter(F.col("deleted_at").isNull())
    return (c.select(as_long("customer_id").alias("customer_id"), "email", "country", "region",
                     F.col("signup_date").cast("string").alias("signup_date"), "account_status",
                     "customer_segment", "device_type", "signup_source")
            .orderBy(F.col("customer_id").desc()).limit(rows))


@register("transaction_extract", "S13", oracle(f"""
SELECT CAST(transaction_id AS BIGINT) AS transaction_id, CAST(customer_id AS BIGINT) AS customer_id,
  CAST(order_date AS VARCHAR) AS order_date, CAST(order_amount AS DOUBLE) AS order_amount,
  product_category, payment_method, shipping_status, CAST(refund_flag AS BIGINT) AS refund_flag
FROM transactions WHERE order_date >= TIMESTAMP '{OA}' - INTERVAL 90 DAY
ORDER BY order_date DESC""", ["transactions"]))
def q_transaction_extract(t):
    from ..functions.exprs import since
    tx = V.transactions(t, where=F.col("o_orderdate") >= since(OA, 90))
    return (tx.select(as_long("transaction_id").alias("transaction_id"), as_long("customer_id").alias("customer_id"),
                      F.col("order_date").cast("string").alias("order_date"),
                      F.col("order_amount").cast("double").alias("order_amount"),
                      "product_category", "payment_method", "shipping_status",
                      as_long("refund_flag").alias("refund_flag"))
            .orderBy(F.col("order_date").desc()))


@register("customer_profile", "F1 F2 F3 F4 F5 F6 F7", oracle(f"""
SELECT CAST(customer_id AS BIGINT) AS customer_id,
  CAST(date_diff('day', CAST(signup_date AS DATE), CAST(TIMESTAMP '{OA}' AS DATE)) AS BIGINT) AS account_age_days,
  CAST(CASE customer_segment WHEN 'VIP' THEN 2 WHEN 'Regular' THEN 1 WHEN 'New' THEN 0 END AS BIGINT) AS customer_segment_encoded,
  CAST(CASE device_type WHEN 'Web' THEN 0 WHEN 'Mobile' THEN 1 WHEN 'App' THEN 2 END AS BIGINT) AS device_type_encoded,
  CAST(CASE signup_source WHEN 'Organic' THEN 0 WHEN 'Paid' THEN 1 WHEN 'Referral' THEN 2 END AS BIGINT) AS signup_source_encoded,
  CAST(CASE WHEN customer_segment = 'VIP' THEN 1 ELSE 0 END AS BIGINT) AS is_vip,
  CAST(CASE WHEN country IN ('US', 'UK', 'DE', 'FR') THEN 1 ELSE 0 END AS BIGINT) AS country_high_value
FROM customers""", ["customers"]))
def q_customer_profile(t):
    return profile_features(V.customers(t), OA)


@register("behavioral_features", "F14 F15 F16 F17 F18 F19 F20", oracle(f"""
WITH g AS (
  SELECT customer_id,
    COUNT(*) FILTER (WHERE event_type = 'page_view') AS pv,
    COUNT(*) FILTER (WHERE event_type = 'add_to_cart') AS atc,
    COUNT(*) FILTER (WHERE event_type = 'purchase') AS pur,
    COUNT(*) AS n, COUNT(DISTINCT session_id) AS sessions,
    MAX(CASE WHEN event_timestamp >= TIMESTAMP '{EA}' - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS recent
  FROM behavior_events GROUP BY customer_id),
r AS (SELECT *, CASE WHEN pur > 0 AND atc > 0 THEN pur / (atc + 1.0) ELSE 0.0 END AS ratio FROM g)
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(pv AS BIGINT) AS page_views,
  CAST(atc AS BIGINT) AS add_to_cart_events, CAST(pur AS BIGINT) AS purchase_events,
  ROUND(pv / n, 6) AS engagement_rate, ROUND(ratio, 6) AS cart_to_purchase_ratio,
  CAST(sessions AS BIGINT) AS sessions, ROUND(n / (sessions + 1), 6) AS avg_events_per_session,
  ROUND(1 - ratio, 6) AS cart_abandonment_rate, CAST(recent AS BIGINT) AS recent_activity_flag
FROM r""", ["behavior_events"]))
def q_behavioral_features(t):
    return behavioral_features(V.behavior_events(t), EA)


@register("engagement_features", "F21 F22 B5", oracle("""
WITH s AS (SELECT customer_id, COUNT(*) AS n, AVG(resolution_hours) AS h, AVG(sentiment_score) AS se
           FROM support_tickets GROUP BY customer_id),
r AS (SELECT customer_id, COUNT(*) AS n, AVG(rating) AS ra, AVG(sentiment_score) AS se
      FROM reviews GROUP BY customer_id)
SELECT CAST(COALESCE(s.customer_id, r.customer_id) AS BIGINT) AS customer_id,
  CAST(COALESCE(s.n, 0) AS BIGINT) AS support_tickets_count,
  ROUND(COALESCE(s.h, 0), 6) AS avg_ticket_resolution_hours,
  ROUND(COALESCE(s.se, 0), 6) AS avg_support_sentiment,
  CAST(COALESCE(r.n, 0) AS BIGINT) AS reviews_count,
  ROUND(COALESCE(r.ra, 0), 6) AS avg_review_rating,
  ROUND(COALESCE(r.se, 0), 6) AS review_sentiment_score
FROM s FULL OUTER JOIN r ON s.customer_id = r.customer_id""", ["support_tickets", "reviews"]))
def q_engagement_features(t):
    return engagement_features(V.support_tickets(t), V.reviews(t))


@register("temporal_features", "F23 F24", oracle("""
SELECT CAST(transaction_id AS BIGINT) AS transaction_id,
  CAST(isodow(order_date) - 1 AS BIGINT) AS day_of_week, CAST(month(order_date) AS BIGINT) AS month,
  CAST(quarter(order_date) AS BIGINT) AS quarter,
  CAST(CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  ROUND(sin(2 * pi() * month(order_date) / 12), 6) + 0.0 AS seasonal_index
FROM transactions""", ["transactions"]))
def q_temporal_features(t):
    return temporal_features(V.transactions(t, lines=False), "order_date", "transaction_id")


@register("period_rollup", "F30", oracle("""
WITH a AS (SELECT MIN(CAST(order_date AS DATE)) AS anchor FROM transactions),
b AS (SELECT customer_id, order_amount,
        CAST(anchor + CAST(FLOOR(date_diff('day', anchor, CAST(order_date AS DATE)) / 30) * 30 AS INTEGER) AS VARCHAR) AS period
      FROM transactions, a)
SELECT CAST(customer_id AS BIGINT) AS customer_id, period,
  ROUND(CAST(SUM(order_amount) AS DOUBLE), 6) AS order_amount_sum,
  CAST(COUNT(order_amount) AS BIGINT) AS order_amount_count,
  ROUND(CAST(SUM(order_amount) AS DOUBLE) / COUNT(order_amount), 6) AS order_amount_mean
FROM b GROUP BY customer_id, period""", ["transactions"]))
def q_period_rollup(t):
    return period_rollup(V.transactions(t, lines=False), "customer_id", "order_amount", "order_date", 30)
