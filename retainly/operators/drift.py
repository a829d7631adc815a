"""Drift detection (M1-M14) over a reference and a current frame.

Both frames are unpivoted once to (feature, value) and tagged with a side;
every test is then a grouped aggregation keyed by feature — the key domain
is the feature list (schema-sized), so per-feature tables are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from .ordered import column_splits, exact_quantiles, ordered_prefix, unpivot
from .quality import _rows, feature_statistics


def reference_statistics(ref: DataFrame, cols) -> DataFrame:
    """M1: mean, sample std, min, max, median and quartiles per column."""
    return feature_statistics(ref, cols).select(
        "column_name", "mean", "std", "min", "max", F.col("q50").alias("median"), "q25", "q75")


def _sides(ref: DataFrame, cur: DataFrame, cols) -> DataFrame:
    r = unpivot(ref, [], cols).withColumn("_side", F.lit("reference"))
    c = unpivot(cur, [], cols).withColumn("_side", F.lit("current"))
    return r.unionByName(c).filter(F.col("value").isNotNull())


def ks_pvalue(d, n, m, terms: int = 100):
    """Asymptotic two-sample KS p-value: 2 sum (-1)^(k-1) exp(-2 k^2 lam^2),
    lam = D sqrt(nm / (n + m)); 1 for lam < 0.27 where the series has not
    converged (its value there is 1 to 6 places)."""
    return _kolmogorov(d * F.sqrt(F.try_divide(n * m, n + m)), terms)


def _kolmogorov(lam, terms: int = 100):
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.27, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_two_sample(ref: DataFrame, cur: DataFrame, cols, threshold: float = 0.15,
                  n_buckets: int | None = None) -> DataFrame:
    """M2-M3: D = max |F_ref - F_cur| over all observed values, per feature,
    exact (ordered prefix counts of both samples), p-value, drift = D > t. A
    feature that is all NULL on one side has no statistic and no drift."""
    long = _sides(ref, cur, cols).select(
        "feature", "value", (F.col("_side") == "reference").cast("bigint").alias("r"),
        (F.col("_side") == "current").cast("bigint").alias("c"))
    splits = column_splits(ref.unionByName(cur), cols, n_buckets)
    op = ordered_prefix(long, "value", ["r", "c"], ["feature"], splits=splits, small_keys=True)
    diff = F.abs(F.try_divide(F.col("r_below") + F.col("r"), F.col("r_total"))
                 - F.try_divide(F.col("c_below") + F.col("c"), F.col("c_total")))
    g = op.groupBy("feature").agg(F.max(diff).alias("d"), F.first("r_total").alias("n"),
                                  F.first("c_total").alias("m"))
    return g.select("feature", as_double("d").alias("ks_statistic"),
                    as_double(F.when(F.col("d").isNotNull(), ks_pvalue(F.col("d"), F.col("n"), F.col("m")))).alias("p_value"),
                    F.coalesce((F.col("d") > threshold).cast("bigint"), F.lit(0)).alias("is_drift"),
                    as_long("n").alias("n_reference"), as_long("m").alias("n_current"))


# The error function's polynomial (absolute error under 1.5e-7).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z):
    """The standard normal distribution function as an expression."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF[0] * x)
    poly = t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * (ERF[4] + t * ERF[5]))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z < 0, (1.0 - erf) / 2).otherwise((1.0 + erf) / 2)


def ks_normal_test(ref: DataFrame, cur: DataFrame, cols, alpha: float = 0.05,
                   n_buckets: int | None = None) -> DataFrame:
    """M4: one-sample KS of each current column against N(mean, std) of the
    reference, asymptotic p-value; drift if p < alpha. All columns in one keyed
    ordered pass; the reference's mean and std are one row per column. A
    constant or empty reference, or no current values, gives no test."""
    stats = unpivot(ref, [], cols).groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    long = unpivot(cur, [], cols).filter(F.col("value").isNotNull()).withColumn("c", F.lit(1).cast("bigint"))
    op = ordered_prefix(long, "value", ["c"], ["feature"], splits=column_splits(cur, cols, n_buckets), small_keys=True)
    j = op.join(F.broadcast(stats), "feature").filter(F.col("_s") > 0)
    p = normal_cdf((F.col("value") - F.col("_m")) / F.col("_s"))
    apart = F.greatest(F.abs(F.col("c_below") / F.col("c_total") - p),
                       F.abs((F.col("c_below") + F.col("c")) / F.col("c_total") - p))
    g = j.groupBy("feature").agg(F.max(apart).alias("d"), F.first("c_total").alias("n"))
    pv = _kolmogorov(F.col("d") * F.sqrt(F.col("n")))
    return g.select("feature", as_double("d").alias("ks_statistic"), as_double(pv).alias("p_value"),
                    (pv < alpha).cast("bigint").alias("is_drift"), as_long("n").alias("n_current"))


def psi(ref: DataFrame, cur: DataFrame, cols, bins: int = 10, threshold: float = 0.2,
        floor: float = 1e-6) -> DataFrame:
    """M5-M6: PSI over `bins` equal-width bins of the reference range. Bins are
    right-closed, the first also admits values down to min - 0.1 % of the
    range; current values outside are counted in `out_of_range` and left out
    of the shares; empty-bin shares are floored at 1e-6."""
    long = _sides(ref, cur, cols)
    edges = long.filter(F.col("_side") == "reference").groupBy("feature") \
        .agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    j = long.join(F.broadcast(edges), "feature")
    rng = F.col("_mx") - F.col("_mn")
    v = F.col("value")
    inside = (v >= F.col("_mn") - 0.001 * rng) & (v <= F.col("_mx"))
    b = F.when(rng == 0, F.when(v == F.col("_mn"), F.lit(1))).otherwise(
        F.when(inside, F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((v - F.col("_mn")) / (rng / bins))))))
    counts = j.groupBy("feature", "_side", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    oor = counts.filter(F.col("bin").isNull() & (F.col("_side") == "current")) \
        .groupBy("feature").agg(F.sum("n").alias("out_of_range"))
    inb = counts.filter(F.col("bin").isNotNull())
    tot = inb.groupBy("feature", "_side").agg(F.sum("n").alias("_tot"))
    share = inb.join(tot, ["feature", "_side"]).select("feature", "_side", "bin", (F.col("n") / F.col("_tot")).alias("s"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    r = share.filter(F.col("_side") == "reference").select("feature", "bin", F.col("s").alias("r"))
    c = share.filter(F.col("_side") == "current").select("feature", "bin", F.col("s").alias("c"))
    full = grid.join(r, ["feature", "bin"], "left").join(c, ["feature", "bin"], "left")
    rs = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(floor))
    cs = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(floor))
    p = full.groupBy("feature").agg(F.sum((cs - rs) * F.log(cs / rs)).alias("psi"))
    out = p.join(oor, "feature", "left")
    return out.select("feature", as_double("psi").alias("psi"), (F.col("psi") > threshold).cast("bigint").alias("high_psi"),
                      as_long(F.coalesce("out_of_range", F.lit(0))).alias("out_of_range"))


def quantile_shift(ref: DataFrame, cur: DataFrame, cols, threshold: float = 0.2) -> DataFrame:
    """M7: sum over quartiles (q_cur - q_ref) ln(q_cur / q_ref) per feature
    (NULL when a ratio is not positive); drift = abs > threshold."""
    probs = [0.25, 0.5, 0.75]
    long = _sides(ref, cur, cols)
    splits = column_splits(ref.unionByName(cur), cols)
    qs = []
    for side in ("reference", "current"):
        q = exact_quantiles(long.filter(F.col("_side") == side), "value", probs, ["feature"], splits=splits,
                            small_keys=True)
        qs.append(q.select("feature", *[F.col(f"q_{i}").alias(f"{side[0]}{i}") for i in range(3)]))
    j = qs[0].join(qs[1], "feature")
    ratio = [F.try_divide(F.col(f"c{i}"), F.col(f"r{i}")) for i in range(3)]
    terms = [F.when(ratio[i] > 0, (F.col(f"c{i}") - F.col(f"r{i}")) * F.log(ratio[i])) for i in range(3)]
    s = terms[0] + terms[1] + terms[2]
    return j.select("feature", as_double(s).alias("quantile_psi"),
                    F.coalesce((F.abs(s) > threshold).cast("bigint"), F.lit(0)).alias("is_drift"))


def label_shift(ref_labels: DataFrame, cur_labels: DataFrame, label: str, kl_threshold: float = 0.1,
                baseline_rate: float = 0.15, rel_threshold: float = 0.05) -> DataFrame:
    """M8-M9: reference / current positive rates, change %, KL(cur || ref)
    with 0 ln 0 = 0, shift flag (KL > 0.1); drift against a fixed baseline
    rate: abs(cur - base) / base > 0.05."""
    r = ref_labels.agg(F.avg(F.col(label).cast("double")).alias("r"))
    c = cur_labels.agg(F.avg(F.col(label).cast("double")).alias("c"))
    j = r.crossJoin(c)
    rr, cc = F.col("r"), F.col("c")

    def term(p, q):
        return F.when(p == 0, F.lit(0.0)).when(q > 0, p * F.log(p / q))

    kl = term(cc, rr) + term(1 - cc, 1 - rr)
    drift = F.abs(cc - baseline_rate) / baseline_rate
    return j.select(as_double(rr).alias("reference_churn_rate"), as_double(cc).alias("current_churn_rate"),
                    as_double(F.when(rr != 0, (cc - rr) / rr * 100)).alias("rate_change_pct"),
                    as_double(kl).alias("kl_divergence"),
                    F.coalesce((kl > kl_threshold).cast("bigint"), F.lit(1)).alias("significant_shift"),
                    as_double(drift).alias("label_drift_score"),
                    (drift > rel_threshold).cast("bigint").alias("label_drift"))


def multi_feature_drift(drift: DataFrame, min_features: int = 3) -> DataFrame:
    """Overall flag when at least `min_features` features drift."""
    g = drift.agg(F.count_if(F.col("is_drift") == 1).alias("n"))
    flag = F.col("n") >= min_features
    return g.select(as_long("n").alias("drifted_features"), flag.cast("bigint").alias("overall_drift"),
                    F.when(flag, "Trigger model retraining").otherwise("No action needed").alias("recommendation"))


def correlation_drift(ref: DataFrame, cur: DataFrame, cols, top_k: int = 3, threshold: float = 0.8) -> DataFrame:
    """Jaccard similarity of the top-k most correlated feature pairs
    (by |corr|, ties by pair name) of both sides; drift when < threshold.
    All pair correlations of a side come from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]

    def top(df, side):
        row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
        long = row.unpivot([], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "r") \
            .select("pair", F.abs("r").alias("r"))
        w = Window.orderBy(F.desc_nulls_last("r"), "pair")
        return long.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_k) \
            .select("pair", F.lit(side).alias("side"))

    both = top(ref, "reference").unionByName(top(cur, "current"))
    g = both.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.count_if(F.col("n") == 2).alias("inter"), F.count(F.lit(1)).alias("uni"))
    jac = F.col("inter") / F.col("uni")
    return s.select(as_double(jac).alias("jaccard"), (jac < threshold).cast("bigint").alias("correlation_drift"))


def score_bins(score: str, bins: int = 10):
    """Number of a [0, 1] score's equal-width bin."""
    return F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")


def hellinger_by(reference: DataFrame, counts: DataFrame, by: str, bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """M12 per group: Hellinger distance of each group's histogram (by, bin, n)
    from the reference histogram (bin, n)."""
    ref = reference.groupBy("bin").agg(F.sum("n").alias("rn"))
    ref = ref.select("bin", (F.col("rn") / F.sum("rn").over(Window.partitionBy())).alias("p"))  # <= bins rows
    cur = counts.groupBy(by, "bin").agg(F.sum("n").alias("cn"))
    cur = cur.select(by, "bin", (F.col("cn") / F.sum("cn").over(Window.partitionBy(by))).alias("q"))
    grid = cur.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(F.broadcast(ref), "bin", "left").join(cur, [by, "bin"], "left")
    t = (F.sqrt(F.coalesce("p", F.lit(0.0))) - F.sqrt(F.coalesce("q", F.lit(0.0)))) ** 2
    g = full.groupBy(by).agg(F.sqrt(F.sum(t) / 2).alias("h"))
    return g.select(by, as_double("h").alias("hellinger"), (F.col("h") > threshold).cast("bigint").alias("prediction_drift"))


def hellinger(ref_scores: DataFrame, cur_scores: DataFrame, score: str, bins: int = 10,
              threshold: float = 0.1) -> DataFrame:
    """Hellinger distance of equal-width [0, 1] score histograms."""
    b = score_bins(score, bins).alias("bin")
    r = ref_scores.groupBy(b).agg(F.count(F.lit(1)).alias("rn"))
    c = cur_scores.groupBy(b).agg(F.count(F.lit(1)).alias("cn"))
    j = r.join(c, "bin", "full").select(F.coalesce("rn", F.lit(0)).alias("rn"), F.coalesce("cn", F.lit(0)).alias("cn"))
    w = Window.partitionBy()
    p = F.col("rn") / F.sum("rn").over(w)
    q = F.col("cn") / F.sum("cn").over(w)
    h = j.select(((F.sqrt(p) - F.sqrt(q)) ** 2).alias("t")).agg(F.sqrt(F.sum("t") / 2).alias("h"))
    return h.select(as_double("h").alias("hellinger"), (F.col("h") > threshold).cast("bigint").alias("prediction_drift"))


def windowed_drift(events: DataFrame, ts: str, value: str, days: int = 30, bins: int = 10,
                   floor: float = 1e-6) -> DataFrame:
    """For each window of `days` days (one begins every day): row count,
    mean, PSI and KS distance of `value` against the whole period, over
    equal-width bins of the whole range. Events are counted per (day, bin)
    once; windows add up that small table."""
    mm = events.agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    d = events.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(mm))
    rng = F.col("_mx") - F.col("_mn")
    b = F.when(rng == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(value) - F.col("_mn")) / (rng / bins)))))
    per_day = d.groupBy(F.to_date(ts).alias("day"), b.cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("sv"))
    ref = per_day.groupBy("bin").agg(F.sum("n").alias("rn"))
    ref = ref.select("bin", (F.col("rn") / F.sum("rn").over(Window.partitionBy())).alias("r"))  # <= bins rows
    wd = per_day.withColumn("w", F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))))
    per = wd.groupBy("w", "bin").agg(F.sum("n").alias("n"), F.sum("sv").alias("sv"))
    tot = per.groupBy("w").agg(F.sum("n").alias("tot"), F.sum("sv").alias("sv"))
    full = tot.crossJoin(F.broadcast(ref)).join(per.select("w", "bin", "n"), ["w", "bin"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("tot")
    in_window = Window.partitionBy("w").orderBy("bin")
    full = full.withColumn("_gap", F.abs(F.sum(share - F.col("r")).over(in_window)))
    cs, rs = F.greatest(share, F.lit(floor)), F.greatest(F.col("r"), F.lit(floor))
    g = full.groupBy("w", "tot", "sv").agg(F.sum((cs - rs) * F.log(cs / rs)).alias("psi"), F.max("_gap").alias("ks"))
    return g.select(F.col("w").cast("string").alias("window_start"), as_long("tot").alias("events"),
                    as_double(F.col("sv").cast("double") / F.col("tot")).alias("mean_value"), as_double("psi").alias("psi"),
                    as_double("ks").alias("ks_statistic"))


# The drift response table (drift type, severity, action).
DRIFT_RULES = [("single feature", "Low", "Monitor, increase check frequency"),
               ("multiple features", "Medium", "Trigger retraining pipeline"),
               ("label shift", "High", "Immediate retraining + alert"),
               ("prediction skew", "Medium", "Investigate model stability")]


def drift_actions(features: DataFrame, label: DataFrame, prediction: DataFrame, min_features: int = 3) -> DataFrame:
    """The response table with a 0/1 flag per drift type. features: rows
    with is_drift (one feature up to min_features - 1 is `single`), label and
    prediction: 1-row results of `label_shift` and `prediction_drift`."""
    n = features.agg(F.count_if(F.col("is_drift") == 1).alias("_n"))
    row = n.crossJoin(label.select(F.col("significant_shift").alias("_l"))) \
        .crossJoin(prediction.select(F.col("prediction_drift").alias("_p")))
    found = [(F.col("_n") >= 1) & (F.col("_n") < min_features), F.col("_n") >= min_features,
             F.col("_l") == 1, F.col("_p") == 1]
    return _rows(row, [(F.lit(kind).alias("drift_type"), F.lit(severity).alias("severity"), F.lit(action).alias("action"),
                        F.coalesce(hit.cast("bigint"), F.lit(0)).alias("detected"))
                       for (kind, severity, action), hit in zip(DRIFT_RULES, found)])
