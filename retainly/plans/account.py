"""Account, subscription and marketing catalog features over the stand-in tables."""

from __future__ import annotations

from ..operators.account import account_extras, account_standing
from ..sources import account_views as A
from ..sources import views as V
from ..sources.views import ORDERS_AS_OF as OA
from .registry import register
from .sqltext import oracle

SQL = f"""
WITH pay AS (SELECT DISTINCT customer_id FROM saved_payment_methods),
ship AS (SELECT DISTINCT customer_id FROM addresses WHERE address_type = 'shipping'),
sub AS (SELECT customer_id, MAX(subscription_end_date) AS ends FROM subscriptions GROUP BY 1),
wish AS (SELECT customer_id, COUNT(*) AS n FROM wishlists WHERE deleted_at IS NULL GROUP BY 1),
mk AS (SELECT customer_id, SUM(spend) AS spend FROM marketing_campaigns GROUP BY 1),
tr AS (SELECT customer_id, CAST(SUM(order_amount) AS DOUBLE) AS ltv,
  COUNT(DISTINCT CASE WHEN order_date >= TIMESTAMP '{OA}' - INTERVAL 30 DAY THEN CAST(order_date AS DATE) END) AS d30
  FROM transactions GROUP BY 1),
j AS (SELECT a.*, pay.customer_id IS NOT NULL AS has_pay, ship.customer_id IS NOT NULL AS has_ship, sub.ends,
    COALESCE(wish.n, 0) AS wish, COALESCE(mk.spend, 0.0) AS spend, COALESCE(tr.ltv, 0.0) AS ltv, COALESCE(tr.d30, 0) AS d30
  FROM accounts a LEFT JOIN pay USING (customer_id) LEFT JOIN ship USING (customer_id) LEFT JOIN sub USING (customer_id)
  LEFT JOIN wish USING (customer_id) LEFT JOIN mk USING (customer_id) LEFT JOIN tr USING (customer_id))
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(LEAST(wish, 10000) AS BIGINT) AS wishlist_items_count,
  CAST(email_verified_at IS NOT NULL AS BIGINT) AS email_verified, CAST(phone_verified_at IS NOT NULL AS BIGINT) AS phone_verified,
  CAST(has_pay AS BIGINT) AS has_saved_payment, CAST(has_ship AS BIGINT) AS has_shipping_address,
  CAST(COALESCE(ends > TIMESTAMP '{OA}', FALSE) AS BIGINT) AS subscription_active,
  CAST(CASE WHEN ends > TIMESTAMP '{OA}'
    THEN LEAST(36, FLOOR(date_diff('day', CAST(TIMESTAMP '{OA}' AS DATE), CAST(ends AS DATE)) / 30.0)) ELSE 0 END AS BIGINT)
    AS subscription_months_remaining,
  CAST(COALESCE(email_marketing_opt_in, FALSE) AS BIGINT) AS email_marketing_opt_in,
  CAST(COALESCE(sms_marketing_opt_in, FALSE) AS BIGINT) AS sms_marketing_opt_in,
  CAST(COALESCE(push_notification_opt_in, FALSE) AS BIGINT) AS push_notification_opt_in,
  ROUND(spend, 6) AS marketing_spend_lifetime_usd,
  ROUND(CASE WHEN spend <> 0 THEN GREATEST(0.0, LEAST(5.0, ltv / spend)) END, 6) AS acquisition_efficiency,
  ROUND(CASE WHEN ends > TIMESTAMP '{OA}' THEN 30.0 / GREATEST(1, d30) ELSE 0.0 END, 6) AS subscription_x_frequency30
FROM j"""


@register("account_extras", "C30 C33 C34 C35 C36 C37 C38 C39 C40 C41 C50 C54 C55",
          oracle(SQL, ["transactions"], **A.view_sql()))
def q_account_extras(t):
    v = {name: A.view(t, name) for name in A.VIEWS}
    return account_extras(v["accounts"], v["saved_payment_methods"], v["addresses"], v["subscriptions"], v["wishlists"],
                          v["marketing_campaigns"], V.transactions(t, lines=False), OA)


@register("account_standing", "C32 C42 C49", oracle(f"""
WITH s AS (SELECT customer_id, AVG(rating) AS rating FROM satisfaction_surveys
  WHERE survey_date >= TIMESTAMP '{OA}' - INTERVAL 365 DAY GROUP BY 1)
SELECT CAST(m.customer_id AS BIGINT) AS customer_id,
  CAST(CASE lower(membership_tier) WHEN 'silver' THEN 2 WHEN 'gold' THEN 3 WHEN 'platinum' THEN 4 ELSE 1 END AS BIGINT) AS membership_tier,
  CAST(CASE lower(acquisition_source) WHEN 'paid_search' THEN 2 WHEN 'social' THEN 3 WHEN 'affiliate' THEN 4
    WHEN 'direct' THEN 5 WHEN 'referral' THEN 5 ELSE 1 END AS BIGINT) AS referral_source,
  ROUND(COALESCE(s.rating, 3.0), 6) AS customer_service_rating_avg
FROM memberships m LEFT JOIN s ON s.customer_id = m.customer_id""", **A.view_sql()))
def q_account_standing(t):
    return account_standing(A.view(t, "memberships"), A.view(t, "satisfaction_surveys"), OA)
