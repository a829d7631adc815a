"""Profile, behavioural, engagement, temporal and period-rollup features.

Each builder is one projection or ONE grouped aggregation keyed on
customer_id (conditional aggregates instead of one group-by per column), so
every builder costs at most one shuffle of partially aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (TWO_PI, as_double, as_long, code_map, days_between, flag,
                               since)

# Category codes of the profile features.
SEGMENT_CODES = {"VIP": 2, "Regular": 1, "New": 0}
DEVICE_CODES = {"Web": 0, "Mobile": 1, "App": 2}
SOURCE_CODES = {"Organic": 0, "Paid": 1, "Referral": 2}
HIGH_VALUE_COUNTRIES = ("US", "UK", "DE", "FR")


def profile_features(customers: DataFrame, as_of: str) -> DataFrame:
    """Account age, segment/device/source codes, VIP and country flags.
    Unknown categories give a NULL code (as a map lookup does)."""
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    return customers.select(
        as_long("customer_id").alias("customer_id"),
        as_long(days_between(as_of_c, "signup_date")).alias("account_age_days"),
        as_long(code_map("customer_segment", SEGMENT_CODES)).alias("customer_segment_encoded"),
        as_long(code_map("device_type", DEVICE_CODES)).alias("device_type_encoded"),
        as_long(code_map("signup_source", SOURCE_CODES)).alias("signup_source_encoded"),
        flag(F.col("customer_segment") == "VIP").alias("is_vip"),
        flag(F.col("country").isin(*HIGH_VALUE_COUNTRIES)).alias("country_high_value"))


def behavioral_features(events: DataFrame, as_of: str, recent_days: int = 7) -> DataFrame:
    """F14-F20 over (customer_id, event_type, session_id, event_timestamp).
    Every customer with at least one event gets a row; absent counts are 0."""
    et = F.col("event_type")
    g = events.groupBy("customer_id").agg(
        F.count_if(et == "page_view").alias("pv"),
        F.count_if(et == "add_to_cart").alias("atc"),
        F.count_if(et == "purchase").alias("pur"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("session_id").alias("sessions"),
        F.max(F.col("event_timestamp") >= since(as_of, recent_days)).alias("recent"))
    ratio = F.when((F.col("pur") > 0) & (F.col("atc") > 0), F.col("pur") / (F.col("atc") + 1)) \
        .otherwise(F.lit(0.0))
    return g.select(
        as_long("customer_id").alias("customer_id"),
        as_long("pv").alias("page_views"),
        as_long("atc").alias("add_to_cart_events"),
        as_long("pur").alias("purchase_events"),
        as_double(F.col("pv") / F.col("n")).alias("engagement_rate"),
        as_double(ratio).alias("cart_to_purchase_ratio"),
        as_long("sessions").alias("sessions"),
        as_double(F.col("n") / (F.col("sessions") + 1)).alias("avg_events_per_session"),
        as_double(1 - ratio).alias("cart_abandonment_rate"),
        flag(F.col("recent")).alias("recent_activity_flag"))


# What stands for missing or empty support and review data.
NEUTRAL_SENTIMENT, NEUTRAL_RATING = 0.5, 3.0


def engagement_features(support: DataFrame, reviews: DataFrame) -> DataFrame:
    """Support and review aggregates, full outer joined on customer_id
    so that support-only and review-only customers both keep a row (fill 0).
    A support table without sentiment, or without rows, gives sentiment 0.5; a
    review table without rows gives rating 3.0 and sentiment 0.5."""
    has = "sentiment_score" in support.columns
    s = support.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("support_tickets_count"),
        F.avg("resolution_hours").alias("avg_ticket_resolution_hours"),
        (F.avg("sentiment_score") if has else F.lit(NEUTRAL_SENTIMENT)).alias("avg_support_sentiment"))
    r = reviews.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("reviews_count"),
        F.avg("rating").alias("avg_review_rating"),
        F.avg("sentiment_score").alias("review_sentiment_score"))
    # 1-row tables: whether either side has rows at all
    some = support.agg((F.count(F.lit(1)) > 0).alias("_some_s")).crossJoin(reviews.agg((F.count(F.lit(1)) > 0).alias("_some_r")))
    j = s.join(r, "customer_id", "full").crossJoin(F.broadcast(some))
    sentiment = F.when(F.col("_some_s") & F.lit(has), 0.0).otherwise(NEUTRAL_SENTIMENT)
    rating = F.when(F.col("_some_r"), 0.0).otherwise(NEUTRAL_RATING)
    review_sentiment = F.when(F.col("_some_r"), 0.0).otherwise(NEUTRAL_SENTIMENT)
    return j.select(
        as_long("customer_id").alias("customer_id"),
        as_long(F.coalesce("support_tickets_count", F.lit(0))).alias("support_tickets_count"),
        as_double(F.coalesce("avg_ticket_resolution_hours", F.lit(0.0))).alias("avg_ticket_resolution_hours"),
        as_double(F.coalesce("avg_support_sentiment", sentiment)).alias("avg_support_sentiment"),
        as_long(F.coalesce("reviews_count", F.lit(0))).alias("reviews_count"),
        as_double(F.coalesce("avg_review_rating", rating)).alias("avg_review_rating"),
        as_double(F.coalesce("review_sentiment_score", review_sentiment)).alias("review_sentiment_score"))


def temporal_features(df: DataFrame, date_col: str, key: str, as_of: str | None = None) -> DataFrame:
    """Monday-0 weekday, month, quarter, weekend flag, seasonal index;
    of `as_of` where df has no such column."""
    if date_col not in df.columns and as_of is None:
        raise ValueError(f"no column {date_col}, and no as_of in its place")
    d = F.col(date_col) if date_col in df.columns else F.lit(as_of).cast("date")
    return df.select(
        as_long(key).alias(key),
        as_long(F.weekday(d)).alias("day_of_week"),
        as_long(F.month(d)).alias("month"),
        as_long(F.quarter(d)).alias("quarter"),
        flag(F.weekday(d) >= 5).alias("is_weekend"),
        as_double(F.sin(F.lit(TWO_PI) * F.month(d) / 12)).alias("seasonal_index"))


def period_rollup(df: DataFrame, customer_col: str, value_col: str, date_col: str,
                  days: int = 30) -> DataFrame:
    """sum / count / mean per (customer, N-day bin); bins start at the
    earliest day in the whole input (midnight) and only non-empty bins appear.
    The anchor is a 1-row global aggregate joined by broadcast."""
    anchor = df.agg(F.min(F.to_date(F.col(date_col))).alias("_anchor"))
    dd = F.to_date(F.col(date_col))
    binned = df.crossJoin(F.broadcast(anchor)).withColumn(
        "period", F.date_add(F.col("_anchor"),
                             (F.floor(F.datediff(dd, F.col("_anchor")) / days) * days).cast("int")))
    g = binned.groupBy(customer_col, "period").agg(
        F.sum(value_col).alias("_s"), F.count(F.col(value_col)).alias("_c"))
    return g.select(
        as_long(customer_col).alias(customer_col),
        F.col("period").cast("string").alias("period"),
        as_double(F.col("_s").cast("double")).alias(f"{value_col}_sum"),
        as_long("_c").alias(f"{value_col}_count"),
        as_double(F.col("_s").cast("double") / F.col("_c")).alias(f"{value_col}_mean"))
