"""Account, subscription and marketing features of the catalog (C30, C33-C41,
C50, C54 and the subscription product of C55).

Every source is aggregated per customer before it meets the customer side, so
each join sees one row per key; a customer that a source lacks gets 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long, clip, days_between, flag, since

# Ranges of the catalog.
WISHLIST_CAP, MONTHS_CAP, EFFICIENCY_CAP = 10000, 36, 5.0


def account_extras(accounts: DataFrame, payments: DataFrame, addresses: DataFrame, subscriptions: DataFrame,
                   wishlists: DataFrame, campaigns: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """One row per account: verification and opt-in flags (NULL -> 0), saved
    payment and shipping address, subscription state, wishlist size, marketing
    spend, lifetime value per spend clipped to [0, 5] (NULL without spend), and
    subscription_active x purchase_frequency_30d = 30 / max(1, order days)."""
    key = "customer_id"
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    inside = F.col("order_date") >= since(as_of, 30)
    sides = [
        payments.groupBy(key).agg(F.count(F.lit(1)).alias("pay")),
        addresses.filter(F.col("address_type") == "shipping").groupBy(key).agg(F.count(F.lit(1)).alias("ship")),
        subscriptions.groupBy(key).agg(F.max("subscription_end_date").alias("ends")),
        wishlists.filter(F.col("deleted_at").isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("wish")),
        campaigns.groupBy(key).agg(F.sum("spend").alias("spend")),
        tx.groupBy(key).agg(F.sum("order_amount").cast("double").alias("ltv"),
                            F.count_distinct(F.when(inside, F.to_date("order_date"))).alias("days30")),
    ]
    j = accounts
    for side in sides:
        j = j.join(side, key, "left")
    active = flag(F.col("ends") > as_of_c)
    months = F.when(F.col("ends") > as_of_c, F.floor(days_between("ends", as_of_c) / 30)).otherwise(F.lit(0))
    spend = F.coalesce("spend", F.lit(0.0))
    frequency = 30.0 / F.greatest(F.lit(1), F.coalesce("days30", F.lit(0)))
    return j.select(
        as_long(key).alias(key),
        as_long(clip(F.coalesce("wish", F.lit(0)), 0, WISHLIST_CAP)).alias("wishlist_items_count"),
        flag(F.col("email_verified_at").isNotNull()).alias("email_verified"),
        flag(F.col("phone_verified_at").isNotNull()).alias("phone_verified"),
        flag(F.col("pay") > 0).alias("has_saved_payment"),
        flag(F.col("ship") > 0).alias("has_shipping_address"),
        active.alias("subscription_active"),
        as_long(clip(months, 0, MONTHS_CAP)).alias("subscription_months_remaining"),
        *[flag(F.col(c)).alias(c) for c in ("email_marketing_opt_in", "sms_marketing_opt_in", "push_notification_opt_in")],
        as_double(spend).alias("marketing_spend_lifetime_usd"),
        as_double(F.when(spend != 0, clip(F.coalesce("ltv", F.lit(0.0)) / spend, 0.0, EFFICIENCY_CAP))).alias("acquisition_efficiency"),
        as_double(active * frequency).alias("subscription_x_frequency30"))


# Codes of membership tiers and acquisition sources, the codes of missing or unlisted ones, and the neutral rating.
TIERS = {"bronze": 1, "silver": 2, "gold": 3, "platinum": 4}
SOURCES = {"organic": 1, "paid_search": 2, "social": 3, "affiliate": 4, "direct": 5, "referral": 5}
MISSING_TIER, MISSING_SOURCE, NEUTRAL_RATING = 1, 1, 3.0


def _code(column: str, codes: dict, missing: int):
    """The column's code, whatever its case; `missing` where it is NULL or unlisted."""
    name = F.lower(F.col(column))
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in codes.items()], F.lit(missing))


def account_standing(members: DataFrame, surveys: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Tier and source codes of every member, and the mean rating of its
    surveys of the last `days` days (NULL ratings skipped). Ratings are summed before
    the shuffle; a member without any is neutral."""
    recent = surveys.where(F.col("survey_date") >= since(as_of, days))
    rated = recent.groupBy("customer_id").agg(F.avg("rating").alias("_rating"))
    return members.join(rated, "customer_id", "left").select(
        as_long("customer_id").alias("customer_id"),
        as_long(_code("membership_tier", TIERS, MISSING_TIER)).alias("membership_tier"),
        as_long(_code("acquisition_source", SOURCES, MISSING_SOURCE)).alias("referral_source"),
        as_double(F.coalesce("_rating", F.lit(NEUTRAL_RATING))).alias("customer_service_rating_avg"))
