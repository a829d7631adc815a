"""Feature tables, scaling, splits, training and scoring queries
(J1-J4, F31-F33, S17-S18, T1-T15, P1-P10, V17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from ..operators import attribution as AT
from ..operators import catalog as K
from ..operators import dataset as DS
from ..operators import quality as Q
from ..operators import score as SC
from ..operators import search as HS
from ..operators import synthetic as SY
from ..operators import train as TR
from ..operators.customer import behavioral_features, engagement_features, profile_features
from ..operators.rfm import rfm_from_raw
from ..operators.transactions import transaction_features, transaction_features_sql
from ..session import materialize, scratch_path
from ..sources import views as V
from ..sources.views import EVENTS_AS_OF as EA
from ..sources.views import ORDERS_AS_OF as OA
from .catalog import _purchase
from .registry import REGISTRY, register
from .sqltext import oracle, r6


def _q(name: str) -> str:
    """Another query's oracle text as a subquery body (DuckDB nests WITH)."""
    return REGISTRY[name].oracle.strip()


TF_COLS = ["lifetime_purchase_value", "total_orders", "average_order_value", "days_since_last_purchase",
           "purchase_frequency", "purchase_value_7d", "order_count_7d", "purchase_value_30d", "order_count_30d",
           "purchase_value_90d", "order_count_90d", "unique_categories", "refund_rate"]
PROFILE_COLS = ["account_age_days", "customer_segment_encoded", "device_type_encoded", "signup_source_encoded",
                "is_vip", "country_high_value"]
RFM_COLS = ["recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score"]
BEH_COLS = ["page_views", "add_to_cart_events", "purchase_events", "engagement_rate", "cart_to_purchase_ratio",
            "sessions", "avg_events_per_session", "cart_abandonment_rate", "recent_activity_flag"]
ENG_COLS = ["support_tickets_count", "avg_ticket_resolution_hours", "avg_support_sentiment", "reviews_count",
            "avg_review_rating", "review_sentiment_score"]


def _feature_table(t):
    prof = profile_features(V.customers(t), OA)
    # one pass over orders and lines per customer, checkpointed: read by the
    # join below and by the RFM ordered passes (recency, frequency and
    # monetary are the same per-customer aggregates)
    tf = materialize(transaction_features(V.transactions(t), OA))
    rf = rfm_from_raw(tf.select("customer_id", F.col("days_since_last_purchase").alias("recency"),
                                F.col("total_orders").alias("frequency"),
                                F.col("lifetime_purchase_value").alias("monetary")))
    bh = behavioral_features(V.behavior_events(t), EA)
    return DS.left_join_all(prof, [tf, rf, bh])


def _coalesced(alias_cols):
    out = []
    for a, cols in alias_cols:
        out += [f"COALESCE({a}.{c}, 0) AS {c}" for c in cols]
    return ",\n  ".join(out)


@register("feature_table", "J1 B3 B4 Q9", oracle(f"""
WITH p AS ({_q('customer_profile')}), tf AS ({_q('transaction_features')}), rf AS ({_q('rfm_scores')}),
bh AS ({_q('behavioral_features')})
SELECT p.customer_id, {_coalesced([('p', PROFILE_COLS), ('tf', TF_COLS), ('rf', RFM_COLS), ('bh', BEH_COLS)])}
FROM p LEFT JOIN tf ON tf.customer_id = p.customer_id LEFT JOIN rf ON rf.customer_id = p.customer_id
LEFT JOIN bh ON bh.customer_id = p.customer_id"""))
def q_feature_table(t):
    return _feature_table(t)


@register("combined_features", "J2", oracle(f"""
WITH tf AS ({_q('transaction_features')}), eg AS ({_q('engagement_features')}), bh AS ({_q('behavioral_features')})
SELECT COALESCE(tf.customer_id, eg.customer_id, bh.customer_id) AS customer_id,
  {_coalesced([('tf', TF_COLS), ('eg', ENG_COLS), ('bh', BEH_COLS)])}
FROM tf FULL OUTER JOIN eg ON eg.customer_id = tf.customer_id
FULL OUTER JOIN bh ON bh.customer_id = COALESCE(tf.customer_id, eg.customer_id)"""))
def q_combined(t):
    tf = transaction_features(V.transactions(t), OA)
    eg = engagement_features(V.support_tickets(t), V.reviews(t))
    bh = behavioral_features(V.behavior_events(t), EA)
    return DS.combine_features([tf, eg, bh])


@register("feature_retrieval", "S17 S18 J4", oracle(f"""
WITH tf AS ({_q('transaction_features')})
SELECT tf.*, 'v1' AS version FROM tf WHERE customer_id IN (SELECT customer_id FROM customers WHERE customer_segment = 'VIP')""",
                                                      ["customers"]))
def q_feature_retrieval(t):
    from ..sources import io as IO
    tf = transaction_features(V.transactions(t), OA)
    path = scratch_path(t.spark, "feature-store")
    IO.store_features(tf, path, "v1")
    ids = V.customers(t).filter(F.col("customer_segment") == "VIP").select("customer_id")
    return IO.retrieve_features(t.spark, path, "v1", ids)


SCALE_COLS = ["lifetime_purchase_value", "total_orders", "average_order_value", "days_since_last_purchase",
              "purchase_frequency"]


@register("standard_scaling", "F31 T3 Q5", oracle(f"""
WITH tf AS ({_q('transaction_features')}),
s AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}' for c in SCALE_COLS)} FROM tf)
SELECT customer_id, {', '.join(f"{r6(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END')} AS {c}" for c in SCALE_COLS)}
FROM tf, s"""))
def q_standard(t):
    tf = transaction_features(V.transactions(t), OA).select("customer_id", *SCALE_COLS)
    s = DS.standard_scale(tf, SCALE_COLS)
    return s.select("customer_id", *[as_double(c).alias(c) for c in SCALE_COLS])


@register("minmax_scaling", "F32", oracle(f"""
WITH tf AS ({_q('transaction_features')}),
s AS (SELECT {', '.join(f'MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}' for c in SCALE_COLS)} FROM tf)
SELECT customer_id, {', '.join(f"ROUND(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END, 6) AS {c}" for c in SCALE_COLS)}
FROM tf, s"""))
def q_minmax(t):
    tf = transaction_features(V.transactions(t), OA).select("customer_id", *SCALE_COLS)
    s = DS.minmax_scale(tf, SCALE_COLS)
    return s.select("customer_id", *[as_double(c).alias(c) for c in SCALE_COLS])


SEGMENTS = ["VIP", "Regular", "New"]


@register("one_hot_encoding", "F33", oracle(f"""
WITH a AS ({_q('catalog_account_features')})
SELECT a.customer_id, {', '.join(f"CAST(c.customer_segment = '{s}' AS BIGINT) AS segment_{s}" for s in SEGMENTS)},
  {', '.join(f'CAST(a.account_created_day_of_week = {d} AS BIGINT) AS dow_{d}' for d in range(7))},
  {', '.join(f'CAST(a.account_created_month = {m} AS BIGINT) AS month_{m}' for m in range(1, 13))},
  {', '.join(f'CAST(a.referral_source = {r} AS BIGINT) AS source_{r}' for r in range(1, 6))}
FROM a JOIN customers c ON c.customer_id = a.customer_id""", ["customers"]))
def q_one_hot(t):
    a = K.catalog_account_features(V.customers(t), V.transactions(t, lines=False), OA)
    c = V.customers(t).select("customer_id", "customer_segment")
    d = a.join(c, "customer_id")
    d = DS.one_hot(d, "customer_segment", SEGMENTS, "segment")
    d = DS.one_hot(d, "account_created_day_of_week", range(7), "dow")
    d = DS.one_hot(d, "account_created_month", range(1, 13), "month")
    d = DS.one_hot(d, "referral_source", range(1, 6), "source")
    keep = [c for c in d.columns if c.startswith(("segment_", "dow_", "month_", "source_"))]
    return d.select("customer_id", *keep)


# --------------------------------------------------------------- datasets
CUT = "2001-01-01 00:00:00"
LABELS_SQL = f"""
SELECT CAST(a.customer_id AS BIGINT) AS customer_id, CAST(CASE WHEN f.customer_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS churn
FROM (SELECT DISTINCT customer_id FROM transactions WHERE order_date >= TIMESTAMP '{CUT}' - INTERVAL 366 DAY
        AND order_date < TIMESTAMP '{CUT}') a
LEFT JOIN (SELECT DISTINCT customer_id FROM transactions WHERE order_date >= TIMESTAMP '{CUT}'
             AND order_date < TIMESTAMP '{CUT}' + INTERVAL 30 DAY) f ON f.customer_id = a.customer_id"""
SPLIT_SQL = f"""
SELECT customer_id, churn,
  CASE WHEN u <= quantile_cont(u, 0.7) OVER (PARTITION BY churn) THEN 'train'
       WHEN u <= quantile_cont(u, 0.85) OVER (PARTITION BY churn) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '-42'), 1, 8))::UBIGINT / 4294967296.0 AS u
      FROM ({LABELS_SQL}))"""


def _labels(t):
    return K.churn_labels(V.transactions(t, lines=False), CUT, 366, 30)


def _split(t):
    labels = materialize(_labels(t))  # read by the cut points, the ranks and the join
    return DS.stratified_split(labels, "customer_id", "churn", 0.15, 0.15, 42)


@register("stratified_split", "T1", oracle(SPLIT_SQL, ["transactions"]))
def q_split(t):
    return _split(t)


@register("temporal_split", "T2", oracle("""
WITH d AS (SELECT transaction_id, customer_id, date_diff('day', DATE '1970-01-01', CAST(order_date AS DATE)) AS dd FROM transactions),
q AS (SELECT quantile_cont(dd, 0.7) AS c1, quantile_cont(dd, 0.85) AS c2 FROM d)
SELECT CAST(transaction_id AS BIGINT) AS transaction_id, CAST(customer_id AS BIGINT) AS customer_id,
  CASE WHEN dd <= c1 THEN 'train' WHEN dd <= c2 THEN 'validation' ELSE 'test' END AS split FROM d, q""",
                                               ["transactions"]))
def q_temporal_split(t):
    tx = V.transactions(t, lines=False).select("transaction_id", "customer_id", "order_date")
    s = DS.temporal_split(tx, "order_date")
    return s.select(as_long("transaction_id").alias("transaction_id"), as_long("customer_id").alias("customer_id"), "split")


@register("class_weights", "T4", oracle(f"""
WITH l AS ({LABELS_SQL}), g AS (SELECT churn, COUNT(*) AS n_c FROM l GROUP BY churn),
t AS (SELECT SUM(n_c) AS n, SUM(CASE WHEN churn = 1 THEN n_c END) AS pos, SUM(CASE WHEN churn <> 1 THEN n_c END) AS neg FROM g)
SELECT CAST(churn AS BIGINT) AS churn, CAST(n_c AS BIGINT) AS count, ROUND(n / (2 * n_c), 6) AS balanced_weight,
  ROUND(neg / pos, 6) AS scale_pos_weight FROM g, t""", ["transactions"]))
def q_class_weights(t):
    return DS.class_weights(_labels(t), "churn")


@register("oversampled_rows", "T5", oracle(f"""
WITH l AS ({LABELS_SQL})
SELECT l.customer_id, l.churn, CAST(k AS BIGINT) AS copy FROM l, range(1, 4) r(k) WHERE l.churn = 0 OR k = 1""",
                                           ["transactions"]))
def q_oversample(t):
    # The minority class of these labels is 0 (most active customers churn
    # within 30 days): flip, replicate x3, flip back.
    lab = _labels(t).withColumn("_minority", (F.col("churn") == 0).cast("int"))
    o = DS.oversample(lab, "_minority", 3)
    return o.select("customer_id", "churn", as_long("copy").alias("copy"))


FEATURES = TF_COLS + PROFILE_COLS


@register("synthetic_minority", "T5", oracle(f"""
WITH l AS ({LABELS_SQL})
SELECT l.customer_id, CAST(k AS BIGINT) AS copy, CAST(1 AS BIGINT) AS between_two FROM l, range(1, 4) r(k) WHERE l.churn = 0""", ["transactions"]))
def q_synthetic(t):
    """Three new rows for each of the minority class, and whether all features lie between the row's and a neighbour's."""
    d = materialize(_labels(t).join(customer_features(t), "customer_id"))
    made = SY.synthetic_minority(d, "customer_id", "churn", FEATURES, minority=0, copies=3)
    real = lambda p: d.where("churn = 0").select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(p + c) for c in FEATURES], F.col("customer_id").alias(p + "id"))
    j = made.join(real("a_"), F.col("customer_id") == F.col("a_id")).join(real("b_"), F.col("neighbour") == F.col("b_id"))
    within = [F.col(c).between(F.least("a_" + c, "b_" + c) - 1e-9, F.greatest("a_" + c, "b_" + c) + 1e-9) for c in FEATURES]
    return j.select("customer_id", "copy", as_long(F.forall(F.array(*within), lambda w: w) & (F.col("a_id") != F.col("b_id"))).alias("between_two"))


def _before(cut):
    """Condition on orders placed before `cut`."""
    return F.col("o_orderdate") < F.lit(cut).cast("timestamp_ntz")


def customer_features(t, cut: str = CUT):
    """FEATURES of every customer as observed strictly before `cut`; NULL where
    a customer has no orders by then."""
    tf = transaction_features(V.transactions(t, where=_before(cut), prune=False), cut)
    return profile_features(V.customers(t), cut).join(tf, "customer_id", "left").select("customer_id", *FEATURES)


def _fit_inputs(t):
    """(labelled, every, params): the split labels with scaled features and
    class weights; all customers with scaled features; the scaling parameters.
    Features are observed strictly before CUT, labels after it; weights and
    scaling parameters come from the training rows alone."""
    every = materialize(customer_features(t))
    split = materialize(_split(t))
    train = split.filter(F.col("split") == "train")
    params = materialize(DS.scaling_params(SC.prepare_features(every.join(train, "customer_id"), FEATURES), FEATURES))
    scaled = materialize(SC.prepare_features(every, FEATURES, params))
    d = DS.with_weights(split, "churn", fit=train).withColumn("label", F.col("churn").cast("double"))
    return materialize(d.join(scaled, "customer_id")), scaled, params, every


def _comparison(t, only=None):
    d = _fit_inputs(t)[0]
    tr, va, te = (d.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    return TR.train_and_compare(tr, va, te, FEATURES, "label", "weight", only)[0]


@register("model_comparison", "T6 T7 T8 T9 T12 B13 B15")
def q_models(t):
    return _comparison(t)


@register("baseline_or_boosted", "T13 T7")
def q_baseline_or_boosted(t):
    return TR.baseline_or_boosted(_comparison(t, ("logistic_regression", "gradient_boosting")))


def fitted_boosted(d):
    """The boosted trees of the training rows, stopped early on the validation rows."""
    fit = d.filter(F.col("split") != "test").withColumn("_stop", F.col("split") == "validation")
    return TR.pipeline(FEATURES, TR.estimators("label", "weight", stop="_stop")["gradient_boosting"]).fit(fit)


@register("feature_importance", "T14")
def q_importance(t):
    """Split gains of the boosted trees, with the mean absolute attribution over all labelled customers."""
    d = _fit_inputs(t)[0]
    m = fitted_boosted(d)
    found = AT.attributions(d, AT.leaf_table(t.spark, m), FEATURES, "customer_id")
    each = found.select(F.explode("attributions").alias("feature", "share"))
    mean = each.groupBy("feature").agg(F.avg(F.abs("share")).alias("mean_attribution"))
    return TR.feature_importance(m, FEATURES).join(mean, "feature").orderBy(F.desc("importance"), "feature")


@register("hyperparameter_search", "T10")
def q_tuning(t):
    """100 trials on training and validation rows, each with what it ran; the best of those not pruned is selected."""
    d = _fit_inputs(t)[0].filter(F.col("split") != "test").withColumn("held", F.col("split") == "validation")
    found = HS.search(d, FEATURES, "label", "weight", "held")
    chosen = HS.best(found) if found else None
    rows = [(x["trial"], *(float(x["point"][k]) for k in HS.SPACE), x["score"], x["rounds"], int(x["pruned"]), int(x["settings"] is chosen)) for x in found]
    names = ", ".join(f"{k} double" for k in HS.SPACE).replace("rounds double", "max_rounds double")
    return t.spark.createDataFrame(rows, f"trial bigint, {names}, roc_auc double, rounds_run bigint, pruned bigint, selected bigint")


@register("cross_validation", "T11")
def q_cv(t):
    tr = _fit_inputs(t)[0].filter(F.col("split") != "test")
    m = TR.cross_validate(tr, FEATURES, "label", "weight")
    rows = [(str({p.name: v for p, v in pm.items()}), float(x)) for pm, x in
            zip(m.getEstimatorParamMaps(), m.avgMetrics)]
    return t.spark.createDataFrame(rows, "params string, roc_auc double")


@register("feature_correlation", "T15", oracle(f"""
WITH l AS ({LABELS_SQL}),
tf AS (WITH transactions AS (SELECT * FROM tx WHERE order_date < TIMESTAMP '{CUT}') {transaction_features_sql(CUT)}),
d AS (SELECT * FROM l JOIN tf USING (customer_id)),
c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CORR(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE)) AS corr FROM d" for c in TF_COLS)})
SELECT feature, {r6('corr')} AS corr, ROUND(ABS(corr), 6) AS abs_corr,
  CAST(ROW_NUMBER() OVER (ORDER BY ROUND(ABS(corr), 6) DESC NULLS LAST, feature) AS BIGINT) AS rank FROM c""",
                                               ["transactions"], tx="SELECT * FROM transactions"))
def q_correlation(t):
    """As of the cut: what came after it is the label's."""
    d = _labels(t).join(transaction_features(V.transactions(t, where=_before(CUT), prune=False), CUT), "customer_id")
    return TR.correlation_selection(d, TF_COLS, "churn")


def fitted_baseline(d):
    """The logistic baseline of the training rows."""
    est = TR.estimators("label", "weight")["logistic_regression"]
    return TR.pipeline(FEATURES, est).fit(d.filter(F.col("split") == "train"))


@register("batch_scores", "P1 P2 P8")
def q_batch_scores(t):
    """All customers by the baseline and by the boosted trees, with the top five features of either."""
    d, every, _, _ = _fit_inputs(t)
    model = fitted_baseline(d)
    coefs = model.stages[-1].coefficients.toArray().tolist()
    scored = SC.score(model, every, 0.35, "v2001", CUT)
    scored = SC.linear_explanation(scored, FEATURES, coefs, 5)
    boosted = fitted_boosted(d)
    found = AT.attributions(every, AT.leaf_table(t.spark, boosted), FEATURES, "customer_id")
    p = TR.probability(boosted.transform(every), "boosted_probability").select("customer_id", *FEATURES, "boosted_probability")
    p = AT.explained(p, found, "customer_id", 5, "boosted_explanation").select("customer_id", "boosted_probability", "boosted_explanation")
    r = SC.risk_fields(scored.select("customer_id", "churn_probability", "model_version", "scored_at",
                                     "explanation"))
    return r.join(p, "customer_id")


@register("risk_report", "P3 P4 P5 P6 P7", oracle("""
SELECT customer_id, segment, churn_probability, actual_churn,
  ROUND(2 * ABS(churn_probability - 0.5), 6) AS confidence,
  ROUND(GREATEST(churn_probability, 1 - churn_probability), 6) AS confidence_max,
  CAST(churn_probability > 0.35 AS BIGINT) AS predicted_churn,
  CASE WHEN churn_probability < 0.3 THEN 'low' WHEN churn_probability <= 0.7 THEN 'medium' ELSE 'high' END AS risk_band,
  ROUND(100 * percent_rank() OVER (ORDER BY churn_probability), 6) AS risk_percentile,
  CASE WHEN churn_probability < 0.3 THEN 'No action' WHEN churn_probability <= 0.7 THEN 'Send engagement offer'
       ELSE 'Enroll in retention campaign' END AS recommendation
FROM predictions""", ["predictions"]))
def q_risk_report(t):
    return SC.risk_fields(V.predictions(t))


@register("risk_counters", "P10", oracle("""
SELECT CASE WHEN churn_probability < 0.3 THEN 'low' WHEN churn_probability <= 0.7 THEN 'medium' ELSE 'high' END AS risk_band,
  CAST(COUNT(*) AS BIGINT) AS customers, ROUND(AVG(2 * ABS(churn_probability - 0.5)), 6) AS avg_confidence
FROM predictions GROUP BY 1""", ["predictions"]))
def q_risk_counters(t):
    p = V.predictions(t)
    return SC.risk_counters(p.select("*", (2 * F.abs(F.col("churn_probability") - 0.5)).alias("confidence"),
                                     F.when(F.col("churn_probability") < SC.LOW_RISK, "low")
                                     .when(F.col("churn_probability") <= SC.HIGH_RISK, "medium")
                                     .otherwise("high").alias("risk_band")))


def _scoring_input(t):
    p = materialize(_purchase(t))  # read by the ranks and the join
    ri = K.rfm_index(p).select("customer_id", F.col("rfm_index").alias("rfm_score"))
    e = K.catalog_engagement_features(V.customers(t), V.behavior_events(t), V.support_tickets(t), V.reviews(t), EA) \
        .select("customer_id", "support_ticket_count_90d")
    return p.select("customer_id", "purchase_count_30d", "total_spend_30d", "days_since_last_purchase",
                    "product_category_diversity").join(ri, "customer_id").join(e, "customer_id")


@register("scoring_validation", "V17 P9", oracle(f"""
WITH pu AS ({_q('catalog_purchase_features')}), ri AS ({_q('catalog_rfm_index')}), en AS ({_q('catalog_engagement_features')}),
d AS (SELECT pu.customer_id, CAST(purchase_count_30d AS DOUBLE) AS purchase_count_30d, CAST(total_spend_30d AS DOUBLE) AS total_spend_30d,
        CAST(days_since_last_purchase AS DOUBLE) AS days_since_last_purchase, CAST(ri.rfm_index AS DOUBLE) AS rfm_score,
        CAST(en.support_ticket_count_90d AS DOUBLE) AS support_ticket_count_90d,
        CAST(product_category_diversity AS DOUBLE) AS product_category_diversity
      FROM pu JOIN ri ON ri.customer_id = pu.customer_id JOIN en ON en.customer_id = pu.customer_id),
r AS (SELECT *, concat_ws(',',
    CASE WHEN purchase_count_30d < 0 OR purchase_count_30d > 1000 THEN 'purchase_count_30d' END,
    CASE WHEN total_spend_30d < 0 OR total_spend_30d > 100000 THEN 'total_spend_30d' END,
    CASE WHEN days_since_last_purchase < 0 OR days_since_last_purchase > 3650 THEN 'days_since_last_purchase' END,
    CASE WHEN rfm_score < 0 OR rfm_score > 100 THEN 'rfm_score' END,
    CASE WHEN support_ticket_count_90d < 0 OR support_ticket_count_90d > 1000 THEN 'support_ticket_count_90d' END,
    CASE WHEN product_category_diversity < 0 OR product_category_diversity > 100 THEN 'product_category_diversity' END) AS reason FROM d)
SELECT customer_id, purchase_count_30d, total_spend_30d, days_since_last_purchase, ROUND(rfm_score, 6) AS rfm_score,
  support_ticket_count_90d, product_category_diversity,
  CASE WHEN reason = '' THEN 'valid' ELSE 'rejected' END AS status, reason AS reject_reason FROM r"""))
def q_scoring_validation(t):
    valid, rejected = Q.validate_scoring_input(_scoring_input(t))
    v = valid.withColumn("status", F.lit("valid")).withColumn("reject_reason", F.lit(""))
    r = rejected.withColumn("status", F.lit("rejected"))
    out = v.unionByName(r)
    return out.withColumn("rfm_score", F.round("rfm_score", 6))
