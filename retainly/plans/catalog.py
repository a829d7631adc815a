"""RFM and feature-catalog queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long, since
from ..operators import affinity as AF
from ..operators import catalog as K
from ..operators import daystate as DY
from ..operators.rfm import rfm_scores
from ..session import materialize, scratch_path
from ..sources import io as IO
from ..sources import views as V
from ..sources.views import EVENTS_AS_OF as EA
from ..sources.views import ORDERS_AS_OF as OA
from .registry import register
from .sqltext import oracle, r6

TS = f"TIMESTAMP '{OA}'"
ETS = f"TIMESTAMP '{EA}'"


def W(d, col="order_date", ts=TS):
    return f"{col} >= {ts} - INTERVAL {d} DAY"


RFM_RAW_SQL = f"""
SELECT customer_id, date_diff('day', CAST(MAX(order_date) AS DATE), CAST({TS} AS DATE)) AS recency,
  COUNT(*) AS frequency, CAST(SUM(order_amount) AS DOUBLE) AS monetary
FROM transactions GROUP BY customer_id"""


@register("rfm_scores", "F25 F26 F27 F28 F29 Q1 Q2", oracle("""
WITH e AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS er, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS em FROM raw),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS rk, COUNT(*) OVER () AS n FROM raw),
s AS (SELECT r.*,
  6 - (1 + (recency > er[1])::INT + (recency > er[2])::INT + (recency > er[3])::INT + (recency > er[4])::INT) AS r_score,
  CASE WHEN n <= 1 THEN 1 ELSE GREATEST(1, (5 * (rk - 1) + n - 2) // (n - 1)) END AS f_score,
  1 + (monetary > em[1])::INT + (monetary > em[2])::INT + (monetary > em[3])::INT + (monetary > em[4])::INT AS m_score
  FROM r, e)
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(recency AS BIGINT) AS recency,
  CAST(frequency AS BIGINT) AS frequency, ROUND(monetary, 6) AS monetary,
  CAST(r_score AS BIGINT) AS r_score, CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score,
  CAST(100 * r_score + 10 * f_score + m_score AS BIGINT) AS rfm_score
FROM s""", ["transactions"], raw=RFM_RAW_SQL))
def q_rfm(t):
    return rfm_scores(V.transactions(t, lines=False), OA)


PURCHASE_SQL = f"""
WITH a AS (SELECT customer_id,
    COUNT(*) FILTER (WHERE {W(7)}) AS c7, COUNT(*) FILTER (WHERE {W(30)}) AS c30,
    COUNT(*) FILTER (WHERE {W(90)}) AS c90, MAX(order_date) AS last,
    SUM(order_amount) FILTER (WHERE {W(7)}) AS s7, SUM(order_amount) FILTER (WHERE {W(30)}) AS s30,
    SUM(order_amount) FILTER (WHERE {W(90)}) AS s90,
    COUNT(DISTINCT CASE WHEN {W(7)} THEN CAST(order_date AS DATE) END) AS d7,
    COUNT(DISTINCT CASE WHEN {W(90)} THEN CAST(order_date AS DATE) END) AS d90,
    COUNT(DISTINCT CASE WHEN {W(90)} THEN payment_method END) AS pm90,
    AVG(CASE WHEN {W(90)} THEN refund_flag END) AS rr90, AVG(CASE WHEN {W(90)} THEN discount_flag END) AS du90,
    COUNT(*) FILTER (WHERE {W(30)} AND NOT ({W(15)})) AS early30, COUNT(*) FILTER (WHERE {W(15)}) AS late30,
    SUM(order_amount) AS ltv
  FROM transactions GROUP BY customer_id),
cat AS (SELECT t.customer_id, COUNT(DISTINCT p.p_type) AS cat90 FROM transactions t
  JOIN lineitem l ON l.l_orderkey = t.transaction_id JOIN part p ON p.p_partkey = l.l_partkey
  WHERE {W(90, 't.order_date')} GROUP BY t.customer_id),
g AS (SELECT customer_id, date_diff('day', CAST(LAG(order_date) OVER (PARTITION BY customer_id
    ORDER BY order_date, transaction_id) AS DATE), CAST(order_date AS DATE)) AS gap
  FROM transactions WHERE {W(90)}),
reg AS (SELECT customer_id, STDDEV_SAMP(gap) AS reg FROM g WHERE gap IS NOT NULL GROUP BY customer_id)
SELECT CAST(c.customer_id AS BIGINT) AS customer_id,
  CAST(COALESCE(c7, 0) AS BIGINT) AS purchase_count_7d, CAST(COALESCE(c30, 0) AS BIGINT) AS purchase_count_30d,
  CAST(COALESCE(c90, 0) AS BIGINT) AS purchase_count_90d,
  CAST(LEAST(COALESCE(date_diff('day', CAST(last AS DATE), CAST({TS} AS DATE)), 365), 15000) AS BIGINT) AS days_since_last_purchase,
  CAST(COALESCE(s7, 0) AS DOUBLE) AS total_spend_7d, CAST(COALESCE(s30, 0) AS DOUBLE) AS total_spend_30d,
  CAST(COALESCE(s90, 0) AS DOUBLE) AS total_spend_90d,
  ROUND(COALESCE(CAST(s30 AS DOUBLE) / c30, 0), 6) AS avg_order_value_30d,
  ROUND(7.0 / GREATEST(1, COALESCE(d7, 0)), 6) AS purchase_frequency_7d,
  ROUND(90.0 / (COALESCE(d90, 0) + 1), 6) AS purchase_frequency_90d,
  CAST(LEAST(COALESCE(date_diff('day', CAST(c.signup_date AS DATE), CAST({TS} AS DATE)), 365), 15000) AS BIGINT) AS days_since_first_purchase,
  ROUND((COALESCE(c30, 0) + 1) / (COALESCE(c90, 0) / 3.0 + 1), 6) AS purchase_trend,
  CAST(CASE WHEN COALESCE(c90, 0) > 0 THEN COALESCE(cat90, 0) ELSE 5 END AS BIGINT) AS product_category_diversity,
  ROUND(COALESCE(reg, 15.0), 6) AS purchase_regularity_std,
  CAST(CASE WHEN COALESCE(c90, 0) > 0 THEN COALESCE(pm90, 0) ELSE 1 END AS BIGINT) AS payment_method_diversity,
  ROUND(LEAST(GREATEST(COALESCE(rr90, 0.0), 0.0), 1.0), 6) AS return_rate_90d,
  ROUND(COALESCE(du90, 0.0), 6) AS discount_usage_rate_90d,
  CAST(COALESCE(du90 > 0.5, FALSE) AS BIGINT) AS price_sensitivity_indicator,
  CAST(COALESCE(early30 > 0 AND late30 > 0, FALSE) AS BIGINT) AS repeat_purchase_rate_30d,
  CAST(COALESCE(c90 > 0, FALSE) AS BIGINT) AS seasonal_purchase_indicator,
  CAST(COALESCE(ltv, 0) AS DOUBLE) AS lifetime_value_usd
FROM customers c LEFT JOIN a ON a.customer_id = c.customer_id LEFT JOIN cat ON cat.customer_id = c.customer_id
LEFT JOIN reg ON reg.customer_id = c.customer_id"""


def _purchase(t):
    """The 90-day slice is cut once (orders and their lines pruned first) and
    feeds the rates, distinct counts, categories and gaps."""
    recent = materialize(V.transactions(t, where=F.col("o_orderdate") >= since(OA, 90)))
    return K.catalog_purchase_features(V.customers(t), V.transactions(t, lines=False), V.line_categories(t, recent), OA, recent)


@register("catalog_purchase_features", "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C17 C18 C19 C20 C21 C22 C23 C24 C46",
          oracle(PURCHASE_SQL, ["customers", "transactions"]))
def q_catalog_purchase(t):
    return _purchase(t)


RFM_INDEX_SQL = """
WITH p AS (SELECT customer_id,
    100 - 100 * percent_rank() OVER (ORDER BY days_since_last_purchase) AS rec,
    100 * percent_rank() OVER (ORDER BY purchase_count_90d) AS fr,
    100 * percent_rank() OVER (ORDER BY total_spend_90d) AS mo FROM purchase)
SELECT customer_id, ROUND(rec, 6) AS rfm_recency, ROUND(fr, 6) AS rfm_frequency, ROUND(mo, 6) AS rfm_monetary,
  ROUND((rec + fr + mo) / 3, 6) AS rfm_index,
  CASE WHEN (rec + fr + mo) / 3 >= 80 THEN 'VIP' WHEN (rec + fr + mo) / 3 >= 50 THEN 'core' ELSE 'at-risk' END AS rfm_tier
FROM p"""


@register("catalog_rfm_index", "C13 C14 C15 C16 B19", oracle(RFM_INDEX_SQL, ["customers", "transactions"],
                                                           purchase=PURCHASE_SQL))
def q_rfm_index(t):
    return K.rfm_index(_purchase(t))


ENGAGEMENT_SQL = f"""
WITH s AS (SELECT customer_id, COUNT(*) FILTER (WHERE {W(30, 'created_date', ETS)}) AS t30,
    COUNT(*) FILTER (WHERE {W(90, 'created_date', ETS)}) AS t90 FROM support_tickets GROUP BY customer_id),
r AS (SELECT customer_id, COUNT(*) FILTER (WHERE {W(90, 'created_date', ETS)}) AS r90,
    AVG(CASE WHEN {W(90, 'created_date', ETS)} THEN rating END) AS rating90,
    AVG(CASE WHEN {W(365, 'created_date', ETS)} THEN rating END) AS rating365 FROM reviews GROUP BY customer_id),
sess AS (SELECT customer_id, session_id, COUNT(*) FILTER (WHERE event_type = 'page_view') AS pv,
    (epoch_us(MAX(event_timestamp)) - epoch_us(MIN(event_timestamp))) / 1e6 AS dur
  FROM behavior_events GROUP BY customer_id, session_id),
sagg AS (SELECT customer_id, AVG(pv) AS pvs, AVG(dur) AS ad FROM sess GROUP BY customer_id),
e AS (SELECT customer_id,
    COUNT(DISTINCT CASE WHEN {W(30, 'event_timestamp', ETS)} THEN CAST(event_timestamp AS DATE) END) AS app30,
    COUNT(*) FILTER (WHERE event_type = 'page_view') AS pv, COUNT(*) FILTER (WHERE event_type = 'purchase') AS pur
  FROM behavior_events GROUP BY customer_id),
c AS (SELECT c.customer_id, s.t30, s.t90, r.r90, r.rating90, r.rating365, e.app30, e.pv, e.pur, sagg.pvs, sagg.ad,
    COALESCE(e.app30, 0) + COALESCE(r.r90, 0) + COALESCE(s.t90, 0) AS eng
  FROM customers c LEFT JOIN s ON s.customer_id = c.customer_id LEFT JOIN r ON r.customer_id = c.customer_id
  LEFT JOIN e ON e.customer_id = c.customer_id LEFT JOIN sagg ON sagg.customer_id = c.customer_id),
mm AS (SELECT MIN(eng) AS lo, MAX(eng) AS hi FROM c)
SELECT CAST(customer_id AS BIGINT) AS customer_id,
  CAST(COALESCE(t30, 0) AS BIGINT) AS support_ticket_count_30d, CAST(COALESCE(t90, 0) AS BIGINT) AS support_ticket_count_90d,
  CAST(COALESCE(t90, 0) AS BIGINT) AS customer_service_contact_count_90d,
  CAST(COALESCE(r90, 0) AS BIGINT) AS review_count_90d,
  ROUND(COALESCE(rating90, 3.0), 6) AS avg_review_rating_90d,
  ROUND(COALESCE(rating365, 3.0), 6) AS customer_service_rating_avg,
  CAST(COALESCE(app30, 0) AS BIGINT) AS app_usage_days_30d,
  ROUND(CASE WHEN hi > lo THEN (eng - lo) / (hi - lo) ELSE 0.0 END, 6) AS engagement_score,
  ROUND(COALESCE(pvs, 0.0), 6) AS page_views_per_session, ROUND(COALESCE(ad, 0.0), 6) AS average_session_duration,
  ROUND(CASE WHEN pur > 0 THEN pv / pur ELSE 0.0 END, 6) AS product_views_to_purchase_ratio
FROM c, mm"""


def _engagement(t):
    return K.catalog_engagement_features(V.customers(t), V.behavior_events(t), V.support_tickets(t),
                                         V.reviews(t), EA)


@register("catalog_engagement_features", "C25 C26 C27 C28 C29 C42 C43 C53 C58",
          oracle(ENGAGEMENT_SQL, ["customers", "behavior_events", "support_tickets", "reviews"]))
def q_catalog_engagement(t):
    return _engagement(t)


@register("catalog_account_features", "C31 C32 C44 C45 C46 C47 C48 C49", oracle(f"""
WITH l AS (SELECT customer_id, CAST(SUM(order_amount) AS DOUBLE) AS ltv FROM transactions GROUP BY customer_id),
c AS (SELECT c.*, COALESCE(l.ltv, 0.0) AS ltv,
    LEAST(COALESCE(date_diff('day', CAST(signup_date AS DATE), CAST({TS} AS DATE)), 0), 15000) AS age
  FROM customers c LEFT JOIN l ON l.customer_id = c.customer_id),
p AS (SELECT quantile_cont(ltv, 0.9) AS p90 FROM c)
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(age AS BIGINT) AS account_age_days,
  CAST(CASE customer_segment WHEN 'New' THEN 1 WHEN 'Regular' THEN 2 WHEN 'VIP' THEN 3 ELSE 1 END AS BIGINT) AS membership_tier,
  CAST(ltv >= p90 AS BIGINT) AS is_vip_customer, CAST(age < 90 AS BIGINT) AS is_new_customer,
  ltv AS lifetime_value_usd,
  CAST(COALESCE(isodow(signup_date) - 1, 3) AS BIGINT) AS account_created_day_of_week,
  CAST(COALESCE(month(signup_date), 6) AS BIGINT) AS account_created_month,
  CAST(CASE signup_source WHEN 'Organic' THEN 1 WHEN 'Paid' THEN 2 WHEN 'Referral' THEN 5 ELSE 1 END AS BIGINT) AS referral_source
FROM c, p""", ["customers", "transactions"]))
def q_catalog_account(t):
    return K.catalog_account_features(V.customers(t), V.transactions(t, lines=False), OA)


@register("catalog_interactions", "C52 C55 C56", oracle(f"""
WITH ri AS ({RFM_INDEX_SQL.strip()}),
sl AS (SELECT customer_id, SUM((30 - date_diff('day', CAST(order_date AS DATE), CAST({TS} AS DATE))) - 14.5) / 2247.5 AS slope
  FROM transactions WHERE {W(30)} GROUP BY customer_id)
SELECT p.customer_id,
  ROUND(CASE WHEN p.purchase_count_90d > 0 AND p.avg_order_value_30d <> 0
    THEN (p.lifetime_value_usd / p.purchase_count_90d) / p.avg_order_value_30d END, 6) AS customer_value_stability,
  ROUND(p.purchase_count_30d * ri.rfm_index, 6) AS count30_x_rfm,
  CAST(p.days_since_last_purchase * e.support_ticket_count_90d AS BIGINT) AS recency_x_tickets90,
  ROUND(p.total_spend_90d * p.product_category_diversity, 6) AS spend90_x_diversity,
  {r6('COALESCE(sl.slope, 0.0)')} AS trend_slope
FROM purchase p JOIN ri ON ri.customer_id = p.customer_id JOIN eng e ON e.customer_id = p.customer_id
LEFT JOIN sl ON sl.customer_id = p.customer_id""",
    ["customers", "transactions", "behavior_events", "support_tickets", "reviews"],
    purchase=PURCHASE_SQL, eng=ENGAGEMENT_SQL))
def q_catalog_interactions(t):
    p = materialize(_purchase(t))  # read for the products and by the ranks
    ri = K.rfm_index(p)
    e = _engagement(t).select("customer_id", "support_ticket_count_90d")
    sl = K.purchase_trend_slope(V.transactions(t, lines=False), OA)
    j = p.join(ri, "customer_id").join(e, "customer_id").join(sl, "customer_id", "left")
    stab = F.when((F.col("purchase_count_90d") > 0) & (F.col("avg_order_value_30d") != 0),
                  (F.col("lifetime_value_usd") / F.col("purchase_count_90d")) / F.col("avg_order_value_30d"))
    return j.select("customer_id", as_double(stab).alias("customer_value_stability"),
                    as_double(F.col("purchase_count_30d") * F.col("rfm_index")).alias("count30_x_rfm"),
                    as_long(F.col("days_since_last_purchase") * F.col("support_ticket_count_90d"))
                    .alias("recency_x_tickets90"),
                    as_double(F.col("total_spend_90d") * F.col("product_category_diversity")).alias("spend90_x_diversity"),
                    as_double(F.coalesce(F.col("trend_slope"), F.lit(0.0))).alias("trend_slope"))


@register("activity_modes", "C57", oracle("""
WITH h AS (SELECT customer_id, hour(event_timestamp) AS hr, COUNT(*) AS n FROM behavior_events GROUP BY 1, 2),
hb AS (SELECT customer_id, arg_min(hr, (-n, hr)) AS peak_hour FROM h GROUP BY 1),
d AS (SELECT customer_id, isodow(order_date) - 1 AS dow, COUNT(*) AS n FROM transactions GROUP BY 1, 2),
db AS (SELECT customer_id, arg_min(dow, (-n, dow)) AS peak_dow FROM d GROUP BY 1)
SELECT CAST(COALESCE(hb.customer_id, db.customer_id) AS BIGINT) AS customer_id,
  CAST(peak_hour AS BIGINT) AS peak_activity_hour, CAST(peak_dow AS BIGINT) AS peak_purchase_day_of_week
FROM hb FULL OUTER JOIN db ON hb.customer_id = db.customer_id""", ["behavior_events", "transactions"]))
def q_activity_modes(t):
    return K.activity_modes(V.behavior_events(t), V.transactions(t, lines=False))


@register("primary_device", "C51", oracle("""
WITH per AS (SELECT customer_id, device_code, COUNT(*) AS n FROM sessions GROUP BY 1, 2),
m AS (SELECT customer_id, device_code FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY n DESC, device_code) AS rn FROM per)
      WHERE rn = 1)
SELECT CAST(c.customer_id AS BIGINT) AS customer_id, CAST(COALESCE(m.device_code, 1) AS BIGINT) AS device_type_primary
FROM customers c LEFT JOIN m ON m.customer_id = c.customer_id""", ["customers", "sessions"]))
def q_primary_device(t):
    return K.primary_device(V.customers(t), V.sessions(t))


@register("category_affinity", "C59", oracle("""
WITH j AS (SELECT t.customer_id, p.p_type FROM transactions t JOIN lineitem l ON l.l_orderkey = t.transaction_id
           JOIN part p ON p.p_partkey = l.l_partkey),
per AS (SELECT customer_id, p_type, COUNT(*) AS n FROM j GROUP BY 1, 2)
SELECT CAST(customer_id AS BIGINT) AS customer_id, p_type AS category, CAST(n AS BIGINT) AS lines,
  ROUND(n / SUM(n) OVER (PARTITION BY customer_id), 6) AS share FROM per""", ["transactions"]))
def q_category_affinity(t):
    return K.category_affinity(V.transactions(t, lines=False), V.line_categories(t))


@register("affinity_vectors", "C59 S17 S18")
def q_affinity_vectors(t):
    """Vectors and best categories, stored by version and read back."""
    prefs = materialize(AF.preferences(V.transactions(t, lines=False), V.line_categories(t)))
    customers, categories = AF.fit(prefs, materialize(AF.numbered(prefs)))
    path = scratch_path(t.spark, "affinity")
    IO.store_features(AF.affinities(customers, categories), path, f"seed-{AF.SEED}")
    return IO.retrieve_features(t.spark, path, f"seed-{AF.SEED}")


@register("affinity_holdout", "C59")
def q_affinity_holdout(t):
    return AF.holdout_ranking(AF.preferences(V.transactions(t, lines=False), V.line_categories(t)))


@register("churn_labels", "C60 J5 B14", oracle("""
WITH a AS (SELECT DISTINCT customer_id FROM transactions
           WHERE order_date >= TIMESTAMP '2001-01-01' - INTERVAL 366 DAY AND order_date < TIMESTAMP '2001-01-01'),
f AS (SELECT DISTINCT customer_id FROM transactions
      WHERE order_date >= TIMESTAMP '2001-01-01' AND order_date < TIMESTAMP '2001-01-01' + INTERVAL 30 DAY)
SELECT CAST(a.customer_id AS BIGINT) AS customer_id, CAST(CASE WHEN f.customer_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS churn
FROM a LEFT JOIN f ON f.customer_id = a.customer_id""", ["transactions"]))
def q_churn_labels(t):
    return K.churn_labels(V.transactions(t, lines=False), "2001-01-01 00:00:00", 366, 30)


# The payment methods of the canonical transactions, a bit each in the state.
METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
AS_OF_DATES = ("2000-06-01", "2001-01-01", OA[:10])
FIXED_DAY = "2000-12-20"


def _as_of_sql(d):
    w = lambda n: f"order_date >= DATE '{d}' - INTERVAL {n} DAY"
    return f"""
SELECT '{d}' AS as_of, CAST(customer_id AS BIGINT) AS customer_id,
  {', '.join(f"CAST(COALESCE(SUM(order_amount) FILTER (WHERE {w(n)}), 0) AS DOUBLE) AS purchase_value_{n}d, CAST(COUNT(*) FILTER (WHERE {w(n)}) AS BIGINT) AS order_count_{n}d" for n in DY.WINDOWS)},
  ROUND(7.0 / GREATEST(1, COUNT(DISTINCT CASE WHEN {w(7)} THEN CAST(order_date AS DATE) END)), 6) AS purchase_frequency_7d,
  ROUND(90.0 / (COUNT(DISTINCT CAST(order_date AS DATE)) + 1), 6) AS purchase_frequency_90d,
  CAST(COUNT(DISTINCT payment_method) AS BIGINT) AS payment_method_diversity
FROM transactions WHERE {w(90)} AND order_date < DATE '{d}' GROUP BY customer_id"""


@register("incremental_features", "F11 C9 C10 C19", oracle(" UNION ALL ".join(_as_of_sql(d) for d in AS_OF_DATES), ["transactions"]))
def q_incremental(t):
    """From a stored state by day, as of three dates; one past day was stored wrong and is replaced by a delta of its own."""
    day = F.to_date("o_orderdate")
    reach = reduce(lambda a, b: a | b, [(day >= F.date_sub(F.lit(d).cast("date"), 90)) & (day < F.lit(d).cast("date")) for d in AS_OF_DATES])
    tx = V.transactions(t, lines=False, where=reach)  # days that a window reaches back to
    path = scratch_path(t.spark, "day-state")
    state = DY.transaction_days(tx, METHODS)
    wrong = F.col("day") == F.lit(FIXED_DAY).cast("date")
    DY.store_days(state.withColumn("orders", F.when(wrong, F.col("orders") + 5).otherwise(F.col("orders"))), path)
    DY.store_days(DY.transaction_days(tx.where(F.to_date("order_date") == F.lit(FIXED_DAY).cast("date")), METHODS), path)
    out = None
    for d in AS_OF_DATES:
        f = DY.window_features(DY.read_days(t.spark, path, d, 90), d)
        f = f.select(F.lit(d).alias("as_of"), as_long("customer_id").alias("customer_id"),
                     *[x for n in DY.WINDOWS for x in (as_double(f"purchase_value_{n}d").alias(f"purchase_value_{n}d"), as_long(f"order_count_{n}d").alias(f"order_count_{n}d"))],
                     as_double("purchase_frequency_7d").alias("purchase_frequency_7d"), as_double("purchase_frequency_90d").alias("purchase_frequency_90d"), "payment_method_diversity")
        out = f if out is None else out.unionByName(f)
    return out
