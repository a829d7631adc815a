"""Feature-catalog builders (C1-C60) with explicit missing-value rules.

Every customer of the customer table gets a row; per-source aggregates are
single conditional group-bys keyed on customer_id, left-joined to it (all
joins on the same key, so each side is shuffled once). Sources the driver
tables lack (wishlists, subscriptions, addresses, marketing, opt-ins,
surveys) are not built; see README. Session devices come from the
`sessions` stand-in view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long, days_between, flag, since
from ..session import materialize
from .ordered import exact_quantiles, forward_fill, percent_ranks

# Catalog caps and missing values.
RECENCY_CAP = 15000
AGE_CAP = 15000
MISSING_RECENCY = 365
MISSING_FIRST_PURCHASE_DAYS = 365
MISSING_CATEGORY_DIVERSITY = 5
MISSING_REGULARITY = 15.0
MISSING_PAYMENT_DIVERSITY = 1
MISSING_REVIEW_RATING = 3.0
MISSING_DAY_OF_WEEK = 3
MISSING_MONTH = 6
MISSING_DEVICE = 1  # desktop
# Stand-in encodings (driver data has segments and signup sources, not tiers).
TIER_CODES = {"New": 1, "Regular": 2, "VIP": 3}
REFERRAL_CODES = {"Organic": 1, "Paid": 2, "Referral": 5}
RFM_TIERS = ((80.0, "VIP"), (50.0, "core"))


def _w(as_of: str, days: int):
    return F.col("order_date") >= since(as_of, days)


def purchase_aggregates(tx: DataFrame, recent: DataFrame, as_of: str) -> DataFrame:
    """C1-C12, C19-C24, C46 per customer with transactions.

    The additive measures come out of one grouped pass over the order columns
    of the whole history. The refund and discount rates and the distinct counts
    (order days in 7/30/90 days, payment methods in 90 days) read only `recent`,
    the 90-day slice with the lines' flags: (customer, day) and
    (customer, method) pairs are deduplicated by partial aggregation and then
    counted. Written as four conditional `count_distinct`s, Spark would
    expand every order of the whole history five times before the shuffle.
    A day counts for a window when its latest order lies inside the window."""
    amt = F.col("order_amount")
    w7, w30, w90 = _w(as_of, 7), _w(as_of, 30), _w(as_of, 90)
    w15 = _w(as_of, 15)
    base = tx.groupBy("customer_id").agg(
        F.count_if(w7).alias("c7"), F.count_if(w30).alias("c30"), F.count_if(w90).alias("c90"),
        F.max("order_date").alias("last"),
        F.sum(F.when(w7, amt)).alias("s7"), F.sum(F.when(w30, amt)).alias("s30"),
        F.sum(F.when(w90, amt)).alias("s90"),
        F.count_if(w30 & ~w15).alias("early30"), F.count_if(w15).alias("late30"),
        F.sum(amt).alias("ltv"))
    rates = recent.groupBy("customer_id").agg(F.avg("refund_flag").alias("rr90"), F.avg("discount_flag").alias("du90"))
    day_last = recent.groupBy("customer_id", F.to_date("order_date").alias("_day")) \
        .agg(F.max("order_date").alias("order_date"))
    days = day_last.groupBy("customer_id").agg(
        F.count_if(_w(as_of, 7)).alias("d7"), F.count_if(_w(as_of, 30)).alias("d30"),
        F.count(F.lit(1)).alias("d90"))
    methods = recent.filter(F.col("payment_method").isNotNull()) \
        .select("customer_id", "payment_method").distinct() \
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("pm90"))
    j = base.join(rates, "customer_id", "left").join(days, "customer_id", "left").join(methods, "customer_id", "left")
    return j.fillna(0, subset=["d7", "d30", "d90", "pm90"])


def category_diversity(recent: DataFrame, lines: DataFrame) -> DataFrame:
    """C17: distinct product categories of the customer's 90-day order lines."""
    j = recent.select("customer_id", "transaction_id").join(lines, F.col("transaction_id") == F.col("l_orderkey"))
    return j.groupBy("customer_id").agg(F.count_distinct("p_type").alias("cat90"))


def purchase_regularity(recent: DataFrame) -> DataFrame:
    """Sample std of day gaps between consecutive 90-day orders (chunked
    lag, so a customer with a third of all orders is split across tasks)."""
    prev = forward_fill(recent.select("customer_id", "transaction_id", "order_date"), ["order_date"], "customer_id", ["order_date", "transaction_id"],
                        include_current=False)
    gaps = prev.filter(F.col("prev_order_date").isNotNull()) \
        .select("customer_id", days_between("order_date", "prev_order_date").alias("gap"))
    return gaps.groupBy("customer_id").agg(F.stddev_samp("gap").alias("reg"))


def catalog_purchase_features(customers: DataFrame, tx: DataFrame, lines: DataFrame, as_of: str,
                              recent: DataFrame | None = None) -> DataFrame:
    """C1-C12, C17-C24, C46 for every customer. `recent`: the 90-day slice of tx
    with refund and discount flags (default: cut from tx), read several times;
    with it, tx needs the order columns alone."""
    recent = tx.filter(_w(as_of, 90)) if recent is None else recent
    a = purchase_aggregates(tx, recent, as_of)
    c = (customers.select("customer_id", "signup_date")
         .join(a, "customer_id", "left")
         .join(category_diversity(recent, lines), "customer_id", "left")
         .join(purchase_regularity(recent), "customer_id", "left"))
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    has90 = F.coalesce(F.col("c90"), F.lit(0)) > 0
    zero_d = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return c.select(
        as_long("customer_id").alias("customer_id"),
        as_long(z("c7")).alias("purchase_count_7d"), as_long(z("c30")).alias("purchase_count_30d"),
        as_long(z("c90")).alias("purchase_count_90d"),
        as_long(F.least(F.coalesce(days_between(as_of_c, "last"), F.lit(MISSING_RECENCY)), F.lit(RECENCY_CAP)))
        .alias("days_since_last_purchase"),
        as_double(zero_d("s7"), None).alias("total_spend_7d"), as_double(zero_d("s30"), None).alias("total_spend_30d"),
        as_double(zero_d("s90"), None).alias("total_spend_90d"),
        as_double(F.coalesce(F.col("s30").cast("double") / F.col("c30"), F.lit(0.0))).alias("avg_order_value_30d"),
        as_double(7.0 / F.greatest(F.lit(1), z("d7"))).alias("purchase_frequency_7d"),
        as_double(90.0 / (z("d90") + 1)).alias("purchase_frequency_90d"),
        as_long(F.least(F.coalesce(days_between(as_of_c, "signup_date"), F.lit(MISSING_FIRST_PURCHASE_DAYS)),
                        F.lit(AGE_CAP))).alias("days_since_first_purchase"),
        as_double((z("c30") + 1) / (z("c90") / 3.0 + 1)).alias("purchase_trend"),
        as_long(F.when(has90, z("cat90")).otherwise(F.lit(MISSING_CATEGORY_DIVERSITY)))
        .alias("product_category_diversity"),
        as_double(F.coalesce(F.col("reg"), F.lit(MISSING_REGULARITY))).alias("purchase_regularity_std"),
        as_long(F.when(has90, z("pm90")).otherwise(F.lit(MISSING_PAYMENT_DIVERSITY)))
        .alias("payment_method_diversity"),
        as_double(F.least(F.greatest(F.coalesce(F.col("rr90"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
        .alias("return_rate_90d"),
        as_double(F.coalesce(F.col("du90"), F.lit(0.0))).alias("discount_usage_rate_90d"),
        flag(F.col("du90") > 0.5).alias("price_sensitivity_indicator"),
        flag((F.col("early30") > 0) & (F.col("late30") > 0)).alias("repeat_purchase_rate_30d"),
        flag(F.col("c90") > 0).alias("seasonal_purchase_indicator"),
        as_double(zero_d("ltv"), None).alias("lifetime_value_usd"))


def rfm_index(purchase: DataFrame) -> DataFrame:
    """Percent ranks of recency (reversed), 90-day count and spend
    over all customers; index = their mean, tiers >= 80 VIP, >= 50 core."""
    d = materialize(purchase.select("customer_id", "days_since_last_purchase", "purchase_count_90d",
                                    "total_spend_90d"))
    d = percent_ranks(d, "customer_id", ["days_since_last_purchase", "purchase_count_90d", "total_spend_90d"])
    rec = 100 - 100 * F.col("days_since_last_purchase_pr")
    fr = 100 * F.col("purchase_count_90d_pr")
    mo = 100 * F.col("total_spend_90d_pr")
    idx = (rec + fr + mo) / 3
    tier = F.when(idx >= RFM_TIERS[0][0], RFM_TIERS[0][1]).when(idx >= RFM_TIERS[1][0], RFM_TIERS[1][1]) \
        .otherwise("at-risk")
    return d.select("customer_id", as_double(rec).alias("rfm_recency"), as_double(fr).alias("rfm_frequency"),
                    as_double(mo).alias("rfm_monetary"), as_double(idx).alias("rfm_index"),
                    tier.alias("rfm_tier"))


def catalog_engagement_features(customers: DataFrame, events: DataFrame, support: DataFrame,
                                reviews: DataFrame, as_of: str) -> DataFrame:
    """C25-C29, C42 (review ratings stand in for surveys), C43, C53, C58 for
    every customer."""
    ts = lambda df, d: F.col("created_date") >= since(as_of, d)
    s = support.groupBy("customer_id").agg(F.count_if(ts(support, 30)).alias("t30"),
                                           F.count_if(ts(support, 90)).alias("t90"))
    r = reviews.groupBy("customer_id").agg(F.count_if(ts(reviews, 90)).alias("r90"),
                                           F.avg(F.when(ts(reviews, 90), F.col("rating"))).alias("rating90"),
                                           F.avg(F.when(ts(reviews, 365), F.col("rating"))).alias("rating365"))
    ev30 = F.col("event_timestamp") >= since(as_of, 30)
    sess = events.groupBy("customer_id", "session_id").agg(
        F.count_if(F.col("event_type") == "page_view").alias("pv"),
        ((F.unix_micros(F.max("event_timestamp").cast("timestamp"))
          - F.unix_micros(F.min("event_timestamp").cast("timestamp"))) / 1e6).alias("dur"))
    sagg = sess.groupBy("customer_id").agg(F.avg("pv").alias("pv_per_session"), F.avg("dur").alias("avg_dur"))
    e = events.groupBy("customer_id").agg(
        F.count_distinct(F.when(ev30, F.to_date("event_timestamp"))).alias("app30"),
        F.count_if(F.col("event_type") == "page_view").alias("pv"),
        F.count_if(F.col("event_type") == "purchase").alias("pur"))
    c = (customers.select("customer_id").join(s, "customer_id", "left").join(r, "customer_id", "left")
         .join(e, "customer_id", "left").join(sagg, "customer_id", "left"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    raw = z("app30") + z("r90") + z("t90")
    c = c.withColumn("_eng", raw)
    mm = c.agg(F.min("_eng").alias("_lo"), F.max("_eng").alias("_hi"))
    c = c.crossJoin(F.broadcast(mm))
    norm = F.when(F.col("_hi") > F.col("_lo"), (F.col("_eng") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) \
        .otherwise(F.lit(0.0))
    return c.select(
        as_long("customer_id").alias("customer_id"),
        as_long(z("t30")).alias("support_ticket_count_30d"), as_long(z("t90")).alias("support_ticket_count_90d"),
        as_long(z("t90")).alias("customer_service_contact_count_90d"),
        as_long(z("r90")).alias("review_count_90d"),
        as_double(F.coalesce(F.col("rating90"), F.lit(MISSING_REVIEW_RATING))).alias("avg_review_rating_90d"),
        as_double(F.coalesce(F.col("rating365"), F.lit(MISSING_REVIEW_RATING))).alias("customer_service_rating_avg"),
        as_long(z("app30")).alias("app_usage_days_30d"),
        as_double(norm).alias("engagement_score"),
        as_double(F.coalesce(F.col("pv_per_session"), F.lit(0.0))).alias("page_views_per_session"),
        as_double(F.coalesce(F.col("avg_dur"), F.lit(0.0))).alias("average_session_duration"),
        as_double(F.when(F.col("pur") > 0, F.col("pv") / F.col("pur")).otherwise(F.lit(0.0)))
        .alias("product_views_to_purchase_ratio"))


def catalog_account_features(customers: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """C31, C32, C44-C49 for every customer. VIP: lifetime spend >= the exact
    90th percentile over customers (a 1-row broadcast statistic)."""
    ltv = tx.groupBy("customer_id").agg(F.sum("order_amount").cast("double").alias("ltv"))
    c = customers.join(ltv, "customer_id", "left").withColumn("ltv", F.coalesce("ltv", F.lit(0.0)))
    p90 = exact_quantiles(c, "ltv", [0.9]).select(F.col("q_0").alias("_p90"))
    c = c.crossJoin(F.broadcast(p90))
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    age = F.least(F.coalesce(days_between(as_of_c, "signup_date"), F.lit(0)), F.lit(AGE_CAP))
    tier = F.coalesce(*[F.when(F.col("customer_segment") == k, F.lit(v)) for k, v in TIER_CODES.items()], F.lit(1))
    ref = F.coalesce(*[F.when(F.col("signup_source") == k, F.lit(v)) for k, v in REFERRAL_CODES.items()], F.lit(1))
    return c.select(
        as_long("customer_id").alias("customer_id"),
        as_long(age).alias("account_age_days"),
        as_long(tier).alias("membership_tier"),
        flag(F.col("ltv") >= F.col("_p90")).alias("is_vip_customer"),
        flag(age < 90).alias("is_new_customer"),
        as_double("ltv", None).alias("lifetime_value_usd"),
        as_long(F.coalesce(F.weekday("signup_date"), F.lit(MISSING_DAY_OF_WEEK))).alias("account_created_day_of_week"),
        as_long(F.coalesce(F.month("signup_date"), F.lit(MISSING_MONTH))).alias("account_created_month"),
        as_long(ref).alias("referral_source"))


def purchase_trend_slope(tx: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Least-squares slope of daily order counts over the last `days`
    days (zero days included). With x = day index 0..days-1, the slope is
    sum over orders of (x - mean x) / sum (x - mean x)^2 — one aggregate, no
    dense day grid."""
    xbar = (days - 1) / 2.0
    sxx = sum((i - xbar) ** 2 for i in range(days))
    x = F.lit(days) - days_between(F.lit(as_of).cast("timestamp_ntz"), "order_date")
    return tx.filter(_w(as_of, days)).groupBy("customer_id") \
        .agg((F.sum(x - F.lit(xbar)) / F.lit(sxx)).alias("trend_slope"))


def mode_of(code: str, count: str, radix: int):
    """Aggregate: the code with the largest count, ties -> smallest code, for
    integer codes in [0, radix). Count and code are packed into one long
    (count * radix + radix - 1 - code), so the mode is a plain `max` and the
    aggregation stays hash-based (no sort of the input)."""
    packed = F.col(count).cast("bigint") * radix + (radix - 1 - F.col(code).cast("bigint"))
    return F.lit(radix - 1) - F.max(packed) % radix


def activity_modes(events: DataFrame, tx: DataFrame) -> DataFrame:
    """Most frequent event hour and order weekday per customer (ties ->
    smallest). Counts are per (customer, hour) first, so no group is collected."""
    h = events.groupBy("customer_id", F.hour("event_timestamp").alias("hour")).count() \
        .groupBy("customer_id").agg(mode_of("hour", "count", 32).alias("peak_hour"))
    d = tx.groupBy("customer_id", F.weekday("order_date").alias("dow")).count() \
        .groupBy("customer_id").agg(mode_of("dow", "count", 8).alias("peak_dow"))
    return h.join(d, "customer_id", "full").select(
        as_long("customer_id").alias("customer_id"), as_long("peak_hour").alias("peak_activity_hour"),
        as_long("peak_dow").alias("peak_purchase_day_of_week"))


def primary_device(customers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Most frequent session device code per customer (ties -> smallest
    code), MISSING_DEVICE without sessions. Sessions are counted per
    (customer, device) first (map-side combine), so a customer with a third
    of all sessions is at most 4 rows when its mode is taken."""
    per = sessions.groupBy("customer_id", "device_code").agg(F.count(F.lit(1)).alias("n"))
    mode = per.groupBy("customer_id").agg(mode_of("device_code", "n", 8).alias("_dev"))
    return customers.select("customer_id").join(mode, "customer_id", "left").select(
        as_long("customer_id").alias("customer_id"),
        as_long(F.coalesce("_dev", F.lit(MISSING_DEVICE))).alias("device_type_primary"))


def category_affinity(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Share of a customer's order lines per product category."""
    j = tx.select("customer_id", "transaction_id").join(lines, F.col("transaction_id") == F.col("l_orderkey"))
    per = j.groupBy("customer_id", "p_type").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("customer_id").agg(F.sum("n").alias("tot"))
    return per.join(tot, "customer_id").select(
        as_long("customer_id").alias("customer_id"), F.col("p_type").alias("category"),
        as_long("n").alias("lines"), as_double(F.col("n") / F.col("tot")).alias("share"))


def churn_labels(tx: DataFrame, cut: str, lookback_days: int = 366, horizon_days: int = 30) -> DataFrame:
    """Customers active in [cut - lookback, cut) get churn = 1 when they
    have no order in [cut, cut + horizon), else 0. One scan of the orders in
    [cut - lookback, cut + horizon) (the range reaches the parquet scan) and
    one partially-aggregated pass per customer computes both flags — no
    distinct sets, no join."""
    cut_c = F.lit(cut).cast("timestamp_ntz")
    lo = cut_c - F.expr(f"INTERVAL {lookback_days} DAYS")
    hi = cut_c + F.expr(f"INTERVAL {horizon_days} DAYS")
    d = F.col("order_date")
    g = tx.filter((d >= lo) & (d < hi)).groupBy("customer_id").agg(
        F.max(d < cut_c).alias("_active"), F.max(d >= cut_c).alias("_back"))
    return g.filter(F.col("_active")).select(
        as_long("customer_id").alias("customer_id"), as_long(F.when(F.col("_back"), 0).otherwise(1)).alias("churn"))
