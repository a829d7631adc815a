"""Evaluation (E1-E11) and drift / monitoring (M1-M22) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from ..operators import drift as D
from ..operators import evaluate as E
from ..operators import monitor as M
from ..operators import sketches as SK
from ..session import scratch_path
from ..sources import derived as X
from ..sources import views as V
from ..sources.views import ORDERS_AS_OF, predictions_at_sql
from .registry import register
from .sqltext import oracle, r6

LABEL, SCORE, SEG = "actual_churn", "churn_probability", "segment"
REF_CUT = "2000-01-01 00:00:00"
THRESHOLDS = [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FEATS = X.DRIFT_FEATURES


# ---------------------------------------------------------------- SQL pieces
def conf_sql(src: str, t: float, keys=()) -> str:
    k = ", ".join(keys)
    kc = k + ", " if k else ""
    gb = f"GROUP BY {k}" if k else ""
    return f"""
SELECT {kc}CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
  ROUND(p, 6) AS precision, ROUND(r, 6) AS recall,
  ROUND(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_score,
  ROUND(CASE WHEN tp + tn + fp + fn <> 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END, 6) AS accuracy,
  ROUND(CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity
FROM (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END AS p,
        CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END AS r
      FROM (SELECT {kc}COUNT(*) FILTER (WHERE NOT ({SCORE} > {t}) AND {LABEL} <> 1) AS tn,
              COUNT(*) FILTER (WHERE {SCORE} > {t} AND {LABEL} <> 1) AS fp,
              COUNT(*) FILTER (WHERE NOT ({SCORE} > {t}) AND {LABEL} = 1) AS fn,
              COUNT(*) FILTER (WHERE {SCORE} > {t} AND {LABEL} = 1) AS tp FROM {src} {gb}))"""


def curve_sql(src: str, keys=()) -> str:
    k = ", ".join(keys)
    kc = k + ", " if k else ""
    part = f"PARTITION BY {k}" if k else ""
    return f"""
SELECT {kc}CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives,
  ROUND(auc, 6) AS roc_auc, ROUND(pr, 6) AS pr_auc, {r6('2 * auc - 1')} AS gini
FROM (
  SELECT {kc}P, N,
    CASE WHEN P > 0 AND N > 0 THEN SUM(pos * (nb + neg / 2.0)) / (P * N) ELSE 0.0 END AS auc,
    CASE WHEN P > 0 THEN SUM(((tp - tp0) / P) * (tp / (tp + fp)
      + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE tp0 / (tp0 + fp0) END) / 2) ELSE 0.0 END AS pr
  FROM (
    SELECT *, P - pb AS tp, N - nb AS fp, P - pb - pos AS tp0, N - nb - neg AS fp0 FROM (
      SELECT *, SUM(pos) OVER ({part}) AS P, SUM(neg) OVER ({part}) AS N,
        COALESCE(SUM(pos) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
        COALESCE(SUM(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT {kc}CAST({SCORE} AS DOUBLE) AS s, SUM(CASE WHEN {LABEL} = 1 THEN 1 ELSE 0 END) AS pos,
              SUM(CASE WHEN {LABEL} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {kc}s)))
  GROUP BY {kc}P, N)"""


def metrics_long_sql(src: str, t: float = 0.5) -> str:
    return f"""
WITH cm AS ({conf_sql(src, t)}), am AS ({curve_sql(src)})
SELECT 'precision' AS metric, precision AS value FROM cm UNION ALL SELECT 'recall', recall FROM cm
UNION ALL SELECT 'f1_score', f1_score FROM cm UNION ALL SELECT 'roc_auc', roc_auc FROM am
UNION ALL SELECT 'pr_auc', pr_auc FROM am"""


def _pred(t):
    return V.predictions(t)


def _pred_ref(t):
    return V.predictions_at(t, REF_CUT)


# ---------------------------------------------------------------- evaluation
@register("confusion_metrics", "E1 E2 E3", oracle(conf_sql("predictions", 0.5), ["predictions"]))
def q_confusion(t):
    return E.confusion_metrics(_pred(t), LABEL, SCORE, 0.5)


@register("roc_pr_auc", "E4 E5 E6 Q6", oracle(curve_sql("predictions"), ["predictions"]))
def q_curves(t):
    return E.curve_metrics(_pred(t), LABEL, SCORE)


@register("calibration_table", "E7", oracle(f"""
WITH g AS (SELECT LEAST(FLOOR({SCORE} * 10), 9) AS bin, COUNT(*) AS n, AVG({SCORE}) AS ms,
             AVG(CAST({LABEL} AS DOUBLE)) AS ar FROM predictions GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, CAST(n AS BIGINT) AS size, ROUND(ms, 6) AS mean_score, ROUND(ar, 6) AS actual_rate,
  ROUND(ABS(ms - ar), 6) AS abs_error, ROUND(MAX(ABS(ms - ar)) OVER (), 6) AS max_calibration_error FROM g""",
                                             ["predictions"]))
def q_calibration(t):
    return E.calibration_table(_pred(t), LABEL, SCORE)


@register("threshold_metrics", "E8 P4", oracle(" UNION ALL ".join(
    f"SELECT CAST({th} AS DOUBLE) AS threshold, * FROM ({conf_sql('predictions', th)})" for th in THRESHOLDS),
    ["predictions"]))
def q_thresholds(t):
    return E.threshold_metrics(_pred(t), LABEL, SCORE, THRESHOLDS)


@register("segment_metrics", "E9", oracle(f"""
SELECT * FROM ({conf_sql('predictions', 0.35, [SEG])}) c JOIN ({curve_sql('predictions', [SEG])}) a USING ({SEG})""",
                                          ["predictions"]))
def q_segments(t):
    return E.segment_metrics(_pred(t), LABEL, SCORE, SEG, 0.35)


@register("region_metrics", "E9", oracle(f"""
WITH pr AS (SELECT p.*, c.region FROM predictions p JOIN customers c ON c.customer_id = p.customer_id)
SELECT * FROM ({conf_sql('pr', 0.35, ['region'])}) c JOIN ({curve_sql('pr', ['region'])}) a USING (region)""",
                                         ["predictions", "customers"]))
def q_regions(t):
    p = _pred(t).join(V.customers(t).select("customer_id", "region"), "customer_id")
    return E.segment_metrics(p, LABEL, SCORE, "region", 0.35)


@register("fairness_gaps", "E10", oracle(f"""
WITH s AS (SELECT * FROM ({conf_sql('predictions', 0.35, [SEG])}) c JOIN ({curve_sql('predictions', [SEG])}) a USING ({SEG})),
b AS (SELECT precision AS bp, recall AS br, roc_auc AS ba FROM s WHERE {SEG} = 'BUILDING')
SELECT {SEG}, roc_auc, precision, recall, {r6('roc_auc - ba')} AS auc_gap, {r6('precision - bp')} AS precision_gap,
  {r6('recall - br')} AS recall_gap FROM s, b""", ["predictions"]))
def q_fairness(t):
    return E.fairness_gaps(_pred(t), LABEL, SCORE, SEG, "BUILDING", 0.35)


@register("metric_gate", "E11", oracle(f"""
WITH m AS (SELECT c.precision, c.recall, a.roc_auc FROM ({conf_sql('predictions', 0.35)}) c, ({curve_sql('predictions')}) a)
SELECT 'roc_auc' AS metric, roc_auc AS value, CAST(0.85 AS DOUBLE) AS floor, CAST(roc_auc >= 0.85 AS BIGINT) AS passed FROM m
UNION ALL SELECT 'precision', precision, CAST(0.78 AS DOUBLE), CAST(precision >= 0.78 AS BIGINT) FROM m
UNION ALL SELECT 'recall', recall, CAST(0.72 AS DOUBLE), CAST(recall >= 0.72 AS BIGINT) FROM m""", ["predictions"]))
def q_gate(t):
    p = _pred(t)
    m = E.confusion_metrics(p, LABEL, SCORE, 0.35).crossJoin(E.curve_metrics(p, LABEL, SCORE))
    return E.metric_gate(m)


# ---------------------------------------------------------------- drift
def _drift_sides_sql():
    return {"ref": X.DRIFT_REF_SQL, "cur": X.DRIFT_CUR_SQL}


@register("reference_statistics", "M1", oracle("\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, "
    f"ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, ROUND(quantile_cont({c}, 0.5), 6) AS median, "
    f"ROUND(quantile_cont({c}, 0.25), 6) AS q25, ROUND(quantile_cont({c}, 0.75), 6) AS q75 FROM ref" for c in FEATS),
    ref=X.DRIFT_REF_SQL))
def q_reference_stats(t):
    ref, _ = X.drift_pair(t)
    return D.reference_statistics(ref, FEATS)


def _long_sql():
    parts = []
    for side in ("ref", "cur"):
        for c in FEATS:
            parts.append(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, '{side}' AS side FROM {side} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


KS_SQL = f"""
WITH l AS ({_long_sql()}),
g AS (SELECT feature, value, SUM(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS r,
        SUM(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS c FROM l GROUP BY 1, 2),
cu AS (SELECT feature, value, SUM(r) OVER w AS cr, SUM(c) OVER w AS cc,
         SUM(r) OVER (PARTITION BY feature) AS n, SUM(c) OVER (PARTITION BY feature) AS m
       FROM g WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, MAX(ABS(cr / n - cc / m)) AS d, MAX(n) AS n, MAX(m) AS m FROM cu GROUP BY feature),
p AS (SELECT feature, d, n, m, d * SQRT(n * m / (n + m)) AS lam FROM d)
SELECT feature, ROUND(d, 6) AS ks_statistic,
  ROUND(CASE WHEN lam < 0.27 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, 2 * (SELECT SUM(POW(-1.0, k - 1) * EXP(-2.0 * k * k * lam * lam))
    FROM range(1, 101) r(k)))) END, 6) AS p_value,
  CAST(d > 0.15 AS BIGINT) AS is_drift, CAST(n AS BIGINT) AS n_reference, CAST(m AS BIGINT) AS n_current FROM p"""


def _ks(t):
    ref, cur = X.drift_pair(t)
    return D.ks_two_sample(ref, cur, FEATS, 0.15)


@register("ks_drift", "M2 M3 J6", oracle(KS_SQL, **_drift_sides_sql()))
def q_ks(t):
    return _ks(t)


_ERF_T = "(1.0 / (1.0 + 0.3275911 * x))"
KS_NORMAL_SQL = f"""
WITH l AS ({_long_sql()}),
st AS (SELECT feature, AVG(value) AS mu, STDDEV_SAMP(value) AS sd FROM l WHERE side = 'ref' GROUP BY feature),
g AS (SELECT feature, value, COUNT(*) AS c FROM l WHERE side = 'cur' GROUP BY 1, 2),
cu AS (SELECT feature, value, c, SUM(c) OVER w AS upto, SUM(c) OVER (PARTITION BY feature) AS n
       FROM g WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z AS (SELECT cu.*, (value - mu) / sd AS z, ABS((value - mu) / sd) / SQRT(2.0) AS x FROM cu JOIN st USING (feature) WHERE sd > 0),
e AS (SELECT *, 1.0 - {_ERF_T} * (0.254829592 + {_ERF_T} * (-0.284496736 + {_ERF_T} * (1.421413741
       + {_ERF_T} * (-1.453152027 + {_ERF_T} * 1.061405429)))) * EXP(-x * x) AS erf FROM z),
p AS (SELECT *, CASE WHEN z < 0 THEN (1.0 - erf) / 2 ELSE (1.0 + erf) / 2 END AS phi FROM e),
d AS (SELECT feature, MAX(GREATEST(ABS((upto - c) / n - phi), ABS(upto / n - phi))) AS d, MAX(n) AS n FROM p GROUP BY feature),
q AS (SELECT *, d * SQRT(n) AS lam FROM d),
r AS (SELECT feature, d, n, CASE WHEN lam < 0.27 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, 2 * (
    SELECT SUM(POW(-1.0, k - 1) * EXP(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k)))) END AS pv FROM q)
SELECT feature, ROUND(d, 6) AS ks_statistic, ROUND(pv, 6) AS p_value, CAST(pv < 0.05 AS BIGINT) AS is_drift,
  CAST(n AS BIGINT) AS n_current FROM r"""


def _ks_normal(t):
    ref, cur = X.drift_pair(t)
    return D.ks_normal_test(ref, cur, FEATS)


@register("ks_normal_test", "M4 B9", oracle(KS_NORMAL_SQL, **_drift_sides_sql()))
def q_ks_normal(t):
    return _ks_normal(t)


PSI_SQL = f"""
WITH l AS ({_long_sql()}),
e AS (SELECT feature, MIN(value) AS mn, MAX(value) AS mx FROM l WHERE side = 'ref' GROUP BY feature),
b AS (SELECT l.feature, l.side, CASE WHEN mx - mn = 0 THEN (CASE WHEN value = mn THEN 1 END)
        WHEN value >= mn - 0.001 * (mx - mn) AND value <= mx
        THEN LEAST(10, GREATEST(1, CAST(CEIL((value - mn) / ((mx - mn) / 10)) AS BIGINT))) END AS bin
      FROM l JOIN e ON e.feature = l.feature),
cn AS (SELECT feature, side, bin, COUNT(*) AS n FROM b GROUP BY 1, 2, 3),
oor AS (SELECT feature, SUM(n) AS o FROM cn WHERE bin IS NULL AND side = 'cur' GROUP BY 1),
sh AS (SELECT feature, side, bin, n / SUM(n) OVER (PARTITION BY feature, side) AS s FROM cn WHERE bin IS NOT NULL),
grid AS (SELECT feature, bin FROM e, range(1, 11) t(bin)),
f AS (SELECT g.feature, GREATEST(COALESCE(r.s, 0.0), 1e-6) AS rs, GREATEST(COALESCE(c.s, 0.0), 1e-6) AS cs
      FROM grid g LEFT JOIN sh r ON r.feature = g.feature AND r.bin = g.bin AND r.side = 'ref'
      LEFT JOIN sh c ON c.feature = g.feature AND c.bin = g.bin AND c.side = 'cur'),
p AS (SELECT feature, SUM((cs - rs) * LN(cs / rs)) AS psi FROM f GROUP BY feature)
SELECT p.feature, ROUND(psi, 6) AS psi, CAST(psi > 0.2 AS BIGINT) AS high_psi,
  CAST(COALESCE(o, 0) AS BIGINT) AS out_of_range FROM p LEFT JOIN oor ON oor.feature = p.feature"""


def _psi(t):
    ref, cur = X.drift_pair(t)
    return D.psi(ref, cur, FEATS)


@register("psi", "M5 M6 Q3 Q4 V15", oracle(PSI_SQL, **_drift_sides_sql()))
def q_psi(t):
    return _psi(t)


@register("quantile_shift", "M7 B10", oracle(f"""
WITH l AS ({_long_sql()}),
q AS (SELECT feature, quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (WHERE side = 'ref') AS r,
        quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (WHERE side = 'cur') AS c FROM l GROUP BY feature),
s AS (SELECT feature,
  (CASE WHEN c[1] / r[1] > 0 THEN (c[1] - r[1]) * LN(c[1] / r[1]) END)
  + (CASE WHEN c[2] / r[2] > 0 THEN (c[2] - r[2]) * LN(c[2] / r[2]) END)
  + (CASE WHEN c[3] / r[3] > 0 THEN (c[3] - r[3]) * LN(c[3] / r[3]) END) AS s FROM q)
SELECT feature, {r6('s')} AS quantile_psi, CAST(COALESCE(ABS(s) > 0.2, FALSE) AS BIGINT) AS is_drift FROM s""",
                                               **_drift_sides_sql()))
def q_quantile_shift(t):
    ref, cur = X.drift_pair(t)
    return D.quantile_shift(ref, cur, FEATS)


LABEL_SQL = f"""
WITH j AS (SELECT (SELECT AVG(CAST({LABEL} AS DOUBLE)) FROM pref) AS r, (SELECT AVG(CAST({LABEL} AS DOUBLE)) FROM predictions) AS c),
k AS (SELECT r, c, (CASE WHEN c = 0 THEN 0.0 WHEN r > 0 THEN c * LN(c / r) END)
         + (CASE WHEN 1 - c = 0 THEN 0.0 WHEN 1 - r > 0 THEN (1 - c) * LN((1 - c) / (1 - r)) END) AS kl FROM j)
SELECT ROUND(r, 6) AS reference_churn_rate, ROUND(c, 6) AS current_churn_rate,
  {r6('CASE WHEN r <> 0 THEN (c - r) / r * 100 END')} AS rate_change_pct, ROUND(kl, 6) AS kl_divergence,
  CAST(COALESCE(kl > 0.1, TRUE) AS BIGINT) AS significant_shift,
  ROUND(ABS(c - 0.15) / 0.15, 6) AS label_drift_score, CAST(ABS(c - 0.15) / 0.15 > 0.05 AS BIGINT) AS label_drift
FROM k"""


def _label(t):
    return D.label_shift(_pred_ref(t), _pred(t), LABEL)


@register("label_shift", "M8 M9 B16", oracle(LABEL_SQL, ["predictions"], pref=predictions_at_sql(REF_CUT)))
def q_label_shift(t):
    return _label(t)


@register("multi_feature_drift", "M10", oracle(f"""
WITH ks AS ({KS_NORMAL_SQL.strip()})
SELECT CAST(COUNT(*) FILTER (WHERE is_drift = 1) AS BIGINT) AS drifted_features,
  CAST(COUNT(*) FILTER (WHERE is_drift = 1) >= 3 AS BIGINT) AS overall_drift,
  CASE WHEN COUNT(*) FILTER (WHERE is_drift = 1) >= 3 THEN 'Trigger model retraining' ELSE 'No action needed' END AS recommendation
FROM ks""", **_drift_sides_sql()))
def q_multi_drift(t):
    return D.multi_feature_drift(_ks_normal(t))


def _pairs():
    return [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]


def _top_sql(side):
    u = " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, ABS(CORR({a}, {b})) AS r FROM {side}" for a, b in _pairs())
    return f"SELECT pair FROM ({u}) ORDER BY r DESC NULLS LAST, pair LIMIT 3"


@register("correlation_drift", "M11", oracle(f"""
WITH a AS ({_top_sql('ref')}), b AS ({_top_sql('cur')}),
u AS (SELECT pair FROM a UNION ALL SELECT pair FROM b),
g AS (SELECT pair, COUNT(*) AS n FROM u GROUP BY pair)
SELECT ROUND(COUNT(*) FILTER (WHERE n = 2) / COUNT(*), 6) AS jaccard,
  CAST(COUNT(*) FILTER (WHERE n = 2) / COUNT(*) < 0.8 AS BIGINT) AS correlation_drift FROM g""", **_drift_sides_sql()))
def q_corr_drift(t):
    ref, cur = X.drift_pair(t)
    return D.correlation_drift(ref, cur, FEATS)


PREDICTION_SQL = f"""
WITH r AS (SELECT LEAST(FLOOR({SCORE} * 10), 9) AS bin, COUNT(*) AS rn FROM pref GROUP BY 1),
c AS (SELECT LEAST(FLOOR({SCORE} * 10), 9) AS bin, COUNT(*) AS cn FROM predictions GROUP BY 1),
j AS (SELECT COALESCE(rn, 0) AS rn, COALESCE(cn, 0) AS cn FROM r FULL OUTER JOIN c ON r.bin = c.bin),
s AS (SELECT SQRT(SUM(POW(SQRT(rn / (SELECT SUM(rn) FROM j)) - SQRT(cn / (SELECT SUM(cn) FROM j)), 2)) / 2) AS h FROM j)
SELECT ROUND(h, 6) AS hellinger, CAST(h > 0.1 AS BIGINT) AS prediction_drift FROM s"""


@register("prediction_drift", "M12", oracle(PREDICTION_SQL, ["predictions"], pref=predictions_at_sql(REF_CUT)))
def q_prediction_drift(t):
    return D.hellinger(_pred_ref(t), _pred(t), SCORE)


@register("windowed_psi", "M13", oracle("""
WITH mm AS (SELECT MIN(value) AS mn, MAX(value) AS mx FROM events),
b AS (SELECT CAST(ts AS DATE) AS day, value, CASE WHEN mx - mn = 0 THEN 1 ELSE LEAST(10, GREATEST(1, CAST(CEIL((value - mn) / ((mx - mn) / 10)) AS BIGINT))) END AS bin
      FROM events, mm WHERE value IS NOT NULL),
ref AS (SELECT bin, COUNT(*) / SUM(COUNT(*)) OVER () AS r FROM b GROUP BY bin),
w AS (SELECT day - CAST(k AS INTEGER) AS ws, bin, value FROM b, range(0, 30) t(k)),
per AS (SELECT ws, bin, COUNT(*) AS n FROM w GROUP BY 1, 2),
tot AS (SELECT ws, COUNT(*) AS tot, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS sv FROM w GROUP BY 1),
f AS (SELECT t.ws, t.tot, t.sv, ref.bin, COALESCE(p.n, 0) / t.tot AS c, ref.r
      FROM tot t CROSS JOIN ref LEFT JOIN per p ON p.ws = t.ws AND p.bin = ref.bin),
g AS (SELECT *, ABS(SUM(c - r) OVER (PARTITION BY ws ORDER BY bin)) AS gap, GREATEST(c, 1e-6) AS cs, GREATEST(r, 1e-6) AS rs FROM f)
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(tot AS BIGINT) AS events, ROUND(sv / tot, 6) AS mean_value,
  ROUND(SUM((cs - rs) * LN(cs / rs)), 6) AS psi, ROUND(MAX(gap), 6) AS ks_statistic FROM g GROUP BY ws, tot, sv"""))
def q_windowed_drift(t):
    return D.windowed_drift(t.events, "ts", "value")


@register("sketched_windows", "M1 M13", oracle("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(value) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY 1),
w AS (SELECT day - CAST(k AS INTEGER) AS ws, n, lo, hi FROM d, range(0, 30) t(k))
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(SUM(n) AS BIGINT) AS events, ROUND(MIN(lo), 6) AS least, ROUND(MAX(hi), 6) AS largest,
  CAST(1 AS BIGINT) AS quartiles_in_order FROM w GROUP BY ws"""))
def q_sketched_windows(t):
    """30-day windows merged from stored daily sketches; the quartiles are tested against their rank error."""
    path = scratch_path(t.spark, "day-sketches")
    SK.store_sketches(SK.daily_sketches(t.events, "ts", ["value"]), path)
    w = SK.windows(SK.read_sketches(t.spark, path), 30)
    c = [F.col(x) for x in ("least", "q25", "q50", "q75", "largest")]
    order = c[0] <= c[1]
    for a, b in zip(c[1:], c[2:]):
        order = order & (a <= b)
    return w.select(F.col("window_start").cast("string").alias("window_start"), as_long("n").alias("events"), as_double("least").alias("least"),
                    as_double("largest").alias("largest"), as_long(order).alias("quartiles_in_order"))


@register("drift_actions", "M14", oracle(f"""
WITH ks AS ({KS_SQL.strip()}), lb AS ({LABEL_SQL.strip()}), pd AS ({PREDICTION_SQL.strip()}),
s AS (SELECT (SELECT COUNT(*) FILTER (WHERE is_drift = 1) FROM ks) AS n, (SELECT significant_shift FROM lb) AS l,
  (SELECT prediction_drift FROM pd) AS p)
SELECT 'single feature' AS drift_type, 'Low' AS severity, 'Monitor, increase check frequency' AS action,
  CAST(n >= 1 AND n < 3 AS BIGINT) AS detected FROM s
UNION ALL SELECT 'multiple features', 'Medium', 'Trigger retraining pipeline', CAST(n >= 3 AS BIGINT) FROM s
UNION ALL SELECT 'label shift', 'High', 'Immediate retraining + alert', CAST(l = 1 AS BIGINT) FROM s
UNION ALL SELECT 'prediction skew', 'Medium', 'Investigate model stability', CAST(p = 1 AS BIGINT) FROM s""",
    ["predictions"], pref=predictions_at_sql(REF_CUT), **_drift_sides_sql()))
def q_drift_actions(t):
    return D.drift_actions(_ks(t), _label(t), D.hellinger(_pred_ref(t), _pred(t), SCORE))


def _degradation(t):
    # both periods scored in ONE keyed metrics pass (one cut-point job, shared
    # shuffles), then compared metric by metric
    both = _pred(t).withColumn("side", F.lit("current")).unionByName(
        _pred_ref(t).withColumn("side", F.lit("baseline")))
    m = M.metrics_long(both, LABEL, SCORE, 0.5, ["side"])
    return M.performance_degradation(m.filter(F.col("side") == "current"),
                                     m.filter(F.col("side") == "baseline"), 0.05)


DEGRADATION_SQL = f"""
WITH c AS ({metrics_long_sql('predictions')}), b AS ({metrics_long_sql('pref')})
SELECT c.metric, c.value AS current, b.value AS baseline,
  {r6('CASE WHEN b.value <> 0 THEN (c.value - b.value) / b.value END')} AS change,
  CAST(COALESCE((c.value - b.value) / NULLIF(b.value, 0) < -0.05, FALSE) AS BIGINT) AS degraded,
  {r6('CASE WHEN b.value <> 0 THEN (b.value - c.value) / b.value ELSE 0.0 END')} AS drop,
  CAST(CASE WHEN b.value <> 0 THEN (b.value - c.value) / b.value ELSE 0.0 END > 0.05 AS BIGINT) AS degraded_variant
FROM c JOIN b ON b.metric = c.metric"""


@register("performance_degradation", "M15 M16 J7", oracle(DEGRADATION_SQL, ["predictions"],
                                                          pref=predictions_at_sql(REF_CUT)))
def q_degradation(t):
    return _degradation(t)


@register("latency_percentiles", "M17", oracle("""
SELECT event_type, CAST(COUNT(value) AS BIGINT) AS n, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
  ROUND(AVG(value), 6) AS mean, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95,
  ROUND(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"""))
def q_latency(t):
    return M.latency_percentiles(t.events, "value", ["event_type"])


@register("monitoring_summary", "M18", oracle(f"""
WITH ks AS ({KS_SQL.strip()}), ps AS ({PSI_SQL.strip()}), lb AS ({LABEL_SQL.strip()})
SELECT (SELECT CAST(COUNT(*) FILTER (WHERE is_drift = 1) AS BIGINT) FROM ks) AS features_with_drift,
  (SELECT CAST(COUNT(*) FILTER (WHERE high_psi = 1) AS BIGINT) FROM ps) AS high_psi_features,
  (SELECT CAST(significant_shift AS BIGINT) FROM lb) AS significant_label_shift""",
                                              ["predictions"], pref=predictions_at_sql(REF_CUT), **_drift_sides_sql()))
def q_summary(t):
    return M.monitoring_summary(_ks(t), _psi(t), _label(t))


RETRAIN_CUT = "2001-01-01 00:00:00"


def _state(t):
    cur = E.curve_metrics(_pred(t), LABEL, SCORE).select(F.col("pr_auc").alias("current_pr_auc"))
    base = E.curve_metrics(_pred_ref(t), LABEL, SCORE).select(F.col("pr_auc").alias("baseline_pr_auc"))
    drift = D.multi_feature_drift(_ks(t)).select(F.col("overall_drift").alias("drift_detected"))
    new = t.orders.filter(F.col("o_orderdate") >= F.lit(RETRAIN_CUT).cast("timestamp_ntz")) \
        .agg(F.count(F.lit(1)).alias("new_samples"))
    age = F.datediff(F.lit(ORDERS_AS_OF).cast("date"), F.lit(RETRAIN_CUT).cast("date"))
    return cur.crossJoin(base).crossJoin(drift).crossJoin(new).select(
        F.lit("v2001").alias("model_version"), "current_pr_auc", "baseline_pr_auc", as_long("drift_detected").alias("drift_detected"),
        as_long(age).alias("days_since_update"), as_long("new_samples").alias("new_samples"))


STATE_SQL = f"""
SELECT 'v2001' AS model_version, (SELECT pr_auc FROM ({curve_sql('predictions')})) AS current_pr_auc,
  (SELECT pr_auc FROM ({curve_sql('pref')})) AS baseline_pr_auc,
  (SELECT CAST(COUNT(*) FILTER (WHERE is_drift = 1) >= 3 AS BIGINT) FROM ks) AS drift_detected,
  CAST(date_diff('day', DATE '{RETRAIN_CUT[:10]}', DATE '{ORDERS_AS_OF[:10]}') AS BIGINT) AS days_since_update,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_orderdate >= TIMESTAMP '{RETRAIN_CUT}') AS new_samples"""


@register("retrain_decision", "M19 B2", oracle(f"""
WITH ks AS ({KS_SQL.strip()}), s AS ({STATE_SQL}),
r AS (SELECT s.*, list_filter([
    CASE WHEN current_pr_auc < baseline_pr_auc * (1 - 0.05) THEN 'Performance degradation (PR-AUC: ' || printf('%.4f', current_pr_auc) || ')' END,
    CASE WHEN drift_detected = 1 THEN 'Data drift detected' END,
    CASE WHEN days_since_update >= 30 THEN 'Model age: ' || CAST(days_since_update AS VARCHAR) || ' days' END,
    CASE WHEN new_samples >= 1000000 THEN 'New samples: ' || format('{{:,}}', new_samples) END], lambda x: x IS NOT NULL) AS k FROM s)
SELECT model_version, current_pr_auc, baseline_pr_auc, drift_detected, days_since_update, new_samples,
  CAST(len(k) > 0 AS BIGINT) AS should_retrain,
  CASE WHEN len(k) > 0 THEN array_to_string(k, '; ') ELSE 'No trigger conditions met' END AS reasons FROM r""",
    ["predictions"], pref=predictions_at_sql(REF_CUT), **_drift_sides_sql()))
def q_retrain(t):
    return M.retrain_decision(_state(t))


@register("retrain_decision_variant", "M20", oracle(f"""
WITH ks AS ({KS_SQL.strip()}), s AS ({STATE_SQL}), dg AS ({DEGRADATION_SQL.strip()}),
r AS (SELECT s.model_version, s.drift_detected, s.days_since_update,
    (SELECT CAST(MAX(degraded) AS BIGINT) FROM dg) AS degraded, CAST(0 AS BIGINT) AS manual FROM s),
k AS (SELECT *, list_filter([CASE WHEN days_since_update IS NULL OR days_since_update >= 30 THEN '30-day scheduled retraining' END,
    CASE WHEN drift_detected = 1 THEN 'Data drift detected' END, CASE WHEN degraded = 1 THEN 'Performance degradation detected' END,
    CASE WHEN manual = 1 THEN 'Manual retraining request' END], lambda x: x IS NOT NULL) AS tr FROM r)
SELECT model_version, drift_detected, days_since_update, degraded, manual, CAST(len(tr) > 0 AS BIGINT) AS should_retrain,
  CASE WHEN len(tr) > 0 THEN array_to_string(tr, '; ') ELSE 'No retraining needed' END AS triggers FROM k""",
    ["predictions"], pref=predictions_at_sql(REF_CUT), **_drift_sides_sql()))
def q_retrain_variant(t):
    s = _state(t).select("model_version", "drift_detected", "days_since_update")
    dg = _degradation(t).agg(F.max("degraded").cast("bigint").alias("degraded"))
    return M.retrain_decision_variant(s.crossJoin(dg).withColumn("manual", F.lit(0).cast("bigint")))


HISTORY_CUTS = ["2000-09-01 00:00:00", "2000-10-01 00:00:00", "2000-11-01 00:00:00", "2000-12-01 00:00:00",
                "2001-01-01 00:00:00", "2001-02-01 00:00:00", "2001-03-01 00:00:00", "2001-04-01 00:00:00"]


def _history(t):
    return M.metric_history(V.predictions_multi(t, HISTORY_CUTS), LABEL, SCORE, 0.5, "v1")


def _history_sql():
    return " UNION ALL ".join(
        f"SELECT 'v1' AS model_version, '{c}' AS ts, metric, value FROM ({metrics_long_sql('h' + str(i))})"
        for i, c in enumerate(HISTORY_CUTS))


def _history_ctes():
    return {f"h{i}": predictions_at_sql(c) for i, c in enumerate(HISTORY_CUTS)}


@register("performance_trend", "M21 S21", oracle(f"""
WITH hist AS ({_history_sql()})
SELECT * FROM hist WHERE model_version = 'v1' AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 180 DAY
ORDER BY ts, metric""", **_history_ctes()))
def q_trend(t):
    return M.performance_trend(_history(t), "v1", ORDERS_AS_OF, 180)


@register("alerts", "M22", oracle(f"""
WITH hist AS ({_history_sql()}), ks AS ({KS_SQL.strip()}), ps AS ({PSI_SQL.strip()}),
f AS (SELECT model_version, metric, arg_min(value, ts) AS base FROM hist GROUP BY 1, 2),
j AS (SELECT h.*, CASE WHEN f.base <> 0 THEN (f.base - h.value) / f.base END AS dr FROM hist h
      JOIN f ON f.model_version = h.model_version AND f.metric = h.metric),
a AS (SELECT model_version, ts, 'performance' AS source, metric, value, {r6('dr')} AS drop,
        CASE WHEN dr > 0.1 THEN 'critical' WHEN dr > 0.05 THEN 'warning' END AS severity
      FROM j WHERE dr > 0.05
      UNION ALL SELECT 'v1', '{ORDERS_AS_OF}', 'ks_drift', feature, ks_statistic, NULL, 'warning' FROM ks WHERE is_drift = 1
      UNION ALL SELECT 'v1', '{ORDERS_AS_OF}', 'psi', feature, psi, NULL, 'critical' FROM ps WHERE high_psi = 1)
SELECT * FROM a WHERE CAST(ts AS TIMESTAMP) >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 6000 HOUR""",
                                    **_history_ctes(), **_drift_sides_sql()))
def q_alerts(t):
    """Metric-drop alerts from the history plus this run's drift alerts,
    within the last 6000 hours."""
    run = M.drift_alerts(_ks(t), _psi(t), "v1", ORDERS_AS_OF)
    hist = M.alerts(_history(t), ORDERS_AS_OF, 6000)
    lo = F.lit(ORDERS_AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 6000 HOURS")
    return hist.unionByName(run.filter(F.col("ts").cast("timestamp_ntz") >= lo))
