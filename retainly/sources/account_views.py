"""Stand-in account tables (FIXTURES.md §3): the driver data has no sign-up
verification, payment, address, subscription, wishlist or campaign tables.

Each view is one definition (table, columns, condition) in SQL that Spark and
DuckDB both read, so the query and its oracle share the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .tables import Tables

VIEWS = {
    "accounts": ("customer", [
        "c_custkey AS customer_id",
        "CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS email_verified_at",
        "CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS phone_verified_at",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS email_marketing_opt_in",
        "CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 4 = 1 END AS sms_marketing_opt_in",
        "CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 6 < 3 END AS push_notification_opt_in"], "TRUE"),
    "saved_payment_methods": ("orders", ["o_custkey AS customer_id", "o_orderpriority AS method"], "o_orderkey % 10 = 0"),
    "addresses": ("orders", [
        "o_custkey AS customer_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'shipping' ELSE 'billing' END AS address_type"], "o_orderkey % 8 = 1"),
    "subscriptions": ("orders", [
        "o_custkey AS customer_id", "o_orderdate + INTERVAL 365 DAY AS subscription_end_date"], "o_orderkey % 4 = 0"),
    "wishlists": ("orders", [
        "o_custkey AS customer_id", "o_orderkey AS item_id",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS deleted_at"], "o_orderkey % 3 = 0"),
    "memberships": ("customer", [
        "c_custkey AS customer_id",
        "CASE c_custkey % 6 WHEN 0 THEN 'bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'gold' WHEN 3 THEN 'platinum' WHEN 4 THEN 'unlisted' END AS membership_tier",
        "CASE c_custkey % 8 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid_search' WHEN 2 THEN 'social' WHEN 3 THEN 'Affiliate' WHEN 4 THEN 'direct' "
        "WHEN 5 THEN 'referral' WHEN 6 THEN 'unlisted' END AS acquisition_source"], "TRUE"),
    "satisfaction_surveys": ("orders", [
        "o_custkey AS customer_id", "o_orderdate AS survey_date",
        "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 5 + 1 END AS rating"], "o_orderkey % 6 = 2"),
    "marketing_campaigns": ("events", ["user_id AS customer_id", "value AS spend"], "event_type = 'view'"),
}


def view(t: Tables, name: str) -> DataFrame:
    table, columns, condition = VIEWS[name]
    return t.table(table).where(condition).selectExpr(*columns)


def view_sql() -> dict[str, str]:
    """DuckDB text of every view, as CTEs."""
    return {name: f"SELECT {', '.join(columns)} FROM {table} WHERE {condition}"
            for name, (table, columns, condition) in VIEWS.items()}
