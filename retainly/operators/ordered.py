"""Global order without a single-partition window.

Ranks, percent ranks, ECDFs, ROC/PR curves, exact quantiles and KS all need
running totals over a *global* value order. A bare `Window.orderBy(v)` moves
every row into one task, so instead:

1. ties are collapsed first: `groupBy(keys, v)` with map-side partial
   aggregation (a value holding a third of all rows becomes one row);
2. the value axis is cut into buckets at approximate quantile splits
   (`approxQuantile`, a bounded list of numbers computed once; they become
   literals, so the bucket of a value is deterministic on re-execution);
3. per-bucket totals (at most keys x buckets rows) give running offsets;
4. a window partitioned by (keys, bucket) adds the within-bucket running sum.

Each window task holds one bucket: about N/buckets distinct values, never a
whole group. The bucket count follows the cluster: by default the session's
`spark.sql.shuffle.partitions` (at least 64, without a cap), so buckets stay
about one shuffle partition in size as the data and the cluster grow.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import not_nan

DEFAULT_BUCKETS = 64
CASE_TREE_MAX = 64  # below this many splits a CASE tree (codegen) is cheapest


def default_buckets(spark) -> int:
    """Buckets per ordered pass: the session's shuffle partitions, at least
    DEFAULT_BUCKETS (cut points are a driver list of as many numbers)."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", str(DEFAULT_BUCKETS)))
    except ValueError:
        n = DEFAULT_BUCKETS
    return max(DEFAULT_BUCKETS, n)


def _nb(df: DataFrame, n_buckets: int | None) -> int:
    return n_buckets if n_buckets is not None else default_buckets(df.sparkSession)


def quantile_splits(df: DataFrame, value, n_buckets: int | None = None,
                    rel_error: float | None = None) -> list[float]:
    """Strictly increasing cut points (row-weighted approximate quantiles).

    Row weighting bounds each bucket by ~N/n_buckets rows, hence also by that
    many distinct values. The list is bounded by n_buckets - 1 numbers.
    """
    n_buckets = _nb(df, n_buckets)
    if n_buckets <= 1:
        return []
    v = F.col(value) if isinstance(value, str) else value
    probs = [i / n_buckets for i in range(1, n_buckets)]
    err = rel_error if rel_error is not None else 1.0 / (4 * n_buckets)
    qs = df.select(v.cast("double").alias("_q")).approxQuantile("_q", probs, err)
    return sorted({float(q) for q in qs if q is not None and not math.isnan(q)})


def _case_tree(v, splits: list[float], lo: int = 0, hi: int | None = None):
    """Number of splits <= v as a binary CASE tree (compact codegen for few splits)."""
    if hi is None:
        hi = len(splits)
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(v >= F.lit(splits[mid - 1]), _case_tree(v, splits, mid, hi)) \
        .otherwise(_case_tree(v, splits, lo, mid - 1))


def _binary_search(v, arr, max_len: int):
    """Number of elements of the sorted array column `arr` that are <= v:
    log2(max_len) halving steps over a literal array, so the expression size
    does not grow with the number of splits (a CASE tree of thousands of
    branches falls out of codegen)."""
    steps, s = [], 1
    while s * 2 <= max_len:
        s *= 2
    while s >= 1:
        steps.append(s)
        s //= 2
    n = F.size(arr)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0),
                       lambda pos, st: F.when((pos + st <= n) & (v >= F.get(arr, pos + st - 1)), pos + st)
                       .otherwise(pos))


def _split_array(splits):
    return F.array(*[F.lit(float(x)) for x in splits]).cast("array<double>")


def bucket_expr(v, splits: list[float]):
    """Index of the bucket holding v: the number of splits <= v."""
    if len(splits) < CASE_TREE_MAX:
        return _case_tree(v, splits)
    return _binary_search(v, _split_array(splits), len(splits))


def keyed_bucket_expr(v, splits, keys):
    """`splits` is a list (shared) or {key value: list} for one key column."""
    if not isinstance(splits, dict):
        return bucket_expr(v, splits)
    if not splits:
        return F.lit(0)
    k = F.col(keys[0])
    longest = max(len(sp) for sp in splits.values())
    if longest >= CASE_TREE_MAX:
        # per-key split arrays in one literal map; unknown keys get bucket 0
        m = F.create_map(*[x for kv, sp in splits.items() for x in (F.lit(kv), _split_array(sp))])
        arr = F.coalesce(F.try_element_at(m, k), F.array().cast("array<double>"))
        return _binary_search(v, arr, max(longest, 1))
    out = None
    for kv, sp in splits.items():
        b = _case_tree(v, sp)
        out = F.when(k == F.lit(kv), b) if out is None else out.when(k == F.lit(kv), b)
    return out.otherwise(F.lit(0))


def with_bucket(df: DataFrame, v, splits, out: str, keys=()) -> DataFrame:
    """`df` plus column `out`: the bucket of v (the number of splits <= v;
    NULL -> 0). A long shared split list goes through Spark ML's `Bucketizer`
    (a JVM binary search, ~6x faster than the array search expression);
    short lists use the CASE tree, per-key split maps the array search."""
    if isinstance(splits, dict) or len(splits) < CASE_TREE_MAX:
        return df.withColumn(out, keyed_bucket_expr(v, splits, list(keys)))
    from pyspark.ml.feature import Bucketizer
    inner = [x for x in splits if math.isfinite(x)]
    tmp = f"_in_{out}"
    d = df.withColumn(tmp, F.coalesce(v.cast("double"), F.lit(float("-inf"))))
    bz = Bucketizer(splits=[float("-inf")] + inner + [float("inf")], inputCol=tmp, outputCol=out,
                    handleInvalid="keep")
    return bz.transform(d).withColumn(out, F.col(out).cast("int")).drop(tmp)


def column_splits(df: DataFrame, cols, n_buckets: int | None = None) -> dict:
    """Per-column cut points for many columns in ONE approxQuantile pass."""
    cols = list(cols)
    n_buckets = _nb(df, n_buckets)
    if not cols or n_buckets <= 1:
        return {c: [] for c in cols}
    probs = [i / n_buckets for i in range(1, n_buckets)]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    qs = d.approxQuantile(cols, probs, 1.0 / (4 * n_buckets))
    return {c: sorted({float(x) for x in q if x is not None and not math.isnan(x)})
            for c, q in zip(cols, qs)}


def unpivot(df: DataFrame, ids, cols, name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns -> (ids..., feature, value double); NaN -> NULL."""
    ids = list(ids)
    d = df.select(*ids, *[not_nan(c).alias(c) for c in cols])
    return d.unpivot(ids, list(cols), name, value)


def ordered_prefix(df: DataFrame, value: str, measures, keys=(), *, splits=None,
                   n_buckets: int | None = None, collapse: bool = True,
                   small_keys: bool = False, carry=()) -> DataFrame:
    """One row per distinct (keys, value) with, for every measure m:
    `m` (sum at this value), `m_below` (sum over strictly smaller values within
    the keys) and `m_total` (sum within the keys). With `collapse=False` one row
    per row of df, whose columns `carry` come along.

    The offsets table has (keys x buckets) rows. It is broadcast explicitly
    only when that is a proven bound: no keys (<= buckets rows) or
    `small_keys=True` (schema-sized keys such as feature names). Otherwise
    the planner decides at run time (AQE's broadcast size check), with a
    shuffle join beyond it.
    """
    keys, measures = list(keys), list(measures)
    if splits is None:
        splits = quantile_splits(df, value, n_buckets)
    if collapse:
        g = df.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    else:
        g = df.select(*keys, value, *measures, *carry)
    g = with_bucket(g, F.col(value).cast("double"), splits, "_bucket", keys)
    per = g.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    w_run = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys)
    off = per.select(*keys, "_bucket",
                     *[F.coalesce(F.sum(f"_b_{m}").over(w_run), F.lit(0)).alias(f"_off_{m}")
                       for m in measures],
                     *[F.sum(f"_b_{m}").over(w_all).alias(f"{m}_total") for m in measures])
    j = g.join(F.broadcast(off) if (small_keys or not keys) else off, keys + ["_bucket"])
    w_in = Window.partitionBy(*keys, "_bucket").orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*keys, value, *measures, *carry,
                    *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(w_in), F.lit(0))).alias(f"{m}_below")
                      for m in measures],
                    *[F.col(f"{m}_total") for m in measures])


def join_by_value(df: DataFrame, table: DataFrame, on, share: int = DEFAULT_BUCKETS) -> DataFrame:
    """Left join of rows with a per-value table (columns `on`, `_cnt`, `_n`). A
    value that holds 1/share of its key's rows or more would put them into one
    task; there are at most `share` such values per key, so they are broadcast
    and their rows stay where they are. All others are joined by a shuffle."""
    hot = F.broadcast(table.filter(F.col("_cnt") * share >= F.col("_n")))
    rest = df.join(hot.select(*on), list(on), "left_anti").join(table, list(on), "left")
    return df.join(hot, list(on)).unionByName(rest)


def rank_first(df: DataFrame, value: str, tie: str, keys=(), n_buckets: int | None = None,
               value_splits=None, tie_splits=None) -> DataFrame:
    """Row-level `rank(method='first')`: 1 + rows with a smaller value + rows
    with an equal value and a smaller `tie` column (unique). Adds `_rank`, `_n`.
    Rows with a NULL value, tie or key have no rank and are left out.

    A value shared by many rows is split across id buckets (second pass keyed
    by value), so no single task holds all its rows. The second pass carries
    the rows' other columns, so rows are never joined back to themselves.
    """
    keys = list(keys)
    ranked = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, value, tie)])
    base = df.where(ranked).withColumn("_one", F.lit(1).cast("bigint"))
    by_value = ordered_prefix(base, value, ["_one"], keys, n_buckets=n_buckets, splits=value_splits) \
        .select(*keys, value, F.col("_one_below").alias("_vb"), F.col("_one").alias("_cnt"), F.col("_one_total").alias("_n"))
    rest = [c for c in df.columns if c not in {*keys, value, tie}]
    within = ordered_prefix(base, tie, ["_one"], keys + [value], n_buckets=n_buckets, collapse=False,
                            small_keys=False, splits=tie_splits, carry=rest) \
        .select(*df.columns, F.col("_one_below").alias("_tb"))
    return (join_by_value(within, by_value, keys + [value])
            .withColumn("_rank", F.col("_vb") + F.col("_tb") + 1).drop("_vb", "_tb", "_cnt"))


def value_ranks(df: DataFrame, value: str, keys=(), n_buckets: int | None = None,
                small_keys: bool = False, splits=None) -> DataFrame:
    """Per distinct (keys, value): `_below` (rows strictly smaller), `_cnt`, `_n`.
    min-rank = _below + 1; percent_rank = _below / (_n - 1)."""
    base = df.select(*keys, value, F.lit(1).cast("bigint").alias("_one")) \
        .filter(F.col(value).isNotNull())
    return ordered_prefix(base, value, ["_one"], keys, n_buckets=n_buckets, small_keys=small_keys,
                          splits=splits) \
        .select(*keys, value, F.col("_one").alias("_cnt"), F.col("_one_below").alias("_below"),
                F.col("_one_total").alias("_n"))


def exact_quantiles(df: DataFrame, value: str, probs, keys=(), n_buckets: int | None = None,
                    small_keys: bool = False, splits=None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / `percentile` / DuckDB
    `quantile_cont` semantics), distributed: the order statistics at ranks
    floor(p(n-1)) and ceil(p(n-1)) are located from the ordered prefix counts.
    Returns one row per key with columns `q_<i>` for each prob (NULL if empty)."""
    keys = list(keys)
    r = value_ranks(df, value, keys, n_buckets, small_keys, splits)
    picks = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        frac = h - lo
        hit_lo = (F.col("_below") <= lo) & (lo < F.col("_below") + F.col("_cnt"))
        hit_hi = (F.col("_below") <= hi) & (hi < F.col("_below") + F.col("_cnt"))
        v = F.col(value).cast("double")
        picks += [F.max(F.when(hit_lo, v)).alias(f"_lo{i}"), F.max(F.when(hit_hi, v)).alias(f"_hi{i}"),
                  F.max(F.when(hit_lo, frac)).alias(f"_f{i}")]
    conds = None  # only the rows holding a needed order statistic survive
    for p in probs:
        h = F.lit(float(p)) * (F.col("_n") - 1)
        c = ((F.col("_below") <= F.ceil(h)) & (F.floor(h) < F.col("_below") + F.col("_cnt")))
        conds = c if conds is None else (conds | c)
    cand = r.filter(conds)
    agg = cand.groupBy(*keys).agg(*picks) if keys else cand.agg(*picks)
    out = agg.select(*keys, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                             .alias(f"q_{i}") for i in range(len(probs))])
    return out


def percent_ranks(df: DataFrame, key: str, cols, n_buckets: int | None = None, suffix: str = "_pr") -> DataFrame:
    """SQL percent_rank of several columns over all rows at once: one cut-point
    pass for all columns, one keyed ordered pass over the unpivoted values,
    one regroup per row key. Adds `<col><suffix>` (NULL for NULL values)."""
    cols = list(cols)
    sp = column_splits(df, cols, n_buckets)
    long = unpivot(df, [key], cols)
    r = value_ranks(long, "value", ["feature"], n_buckets, small_keys=True, splits=sp)
    pr = F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    j = join_by_value(long, r.select("feature", "value", "_cnt", "_n", pr.alias("_pr")), ["feature", "value"])
    wide = j.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("_pr"))).alias(f"{c}{suffix}")
                                for c in cols])
    return df.join(wide, key, "left")


def _order_number(df: DataFrame, c: str):
    """A numeric image of an order column (timestamps as epoch microseconds)."""
    x = F.col(c)
    return F.unix_micros(x.cast("timestamp")).cast("double") \
        if dict(df.dtypes)[c].startswith("timestamp") else x.cast("double")


def _raw_quantiles(df: DataFrame, value: str, n_buckets: int) -> list[float]:
    """Row-weighted approximate quantiles with repeats kept (a repeated value
    holds at least 1/n_buckets of the rows)."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.select(F.col(value).cast("double").alias("_q")).approxQuantile("_q", probs, 1.0 / (4 * n_buckets))
    return [float(q) for q in qs if q is not None and not math.isnan(q)]


def forward_fill(df: DataFrame, cols, key, order, n_chunks: int | None = None,
                 include_current: bool = True) -> DataFrame:
    """Last non-null value at or before each row, per key, in `order` order
    (`include_current=False`: strictly before, i.e. a null-skipping lag).

    The order axis is cut into chunks (quantile splits of the first order
    column), so a key holding a third of all rows is spread over n_chunks
    window tasks; the last value of earlier chunks is carried over through a
    per-(key, chunk) table. `order`: list of columns, unique per key.

    A first-order value holding at least 1/n_chunks of the rows (it repeats
    in the quantile list: e.g. a batch of events with one timestamp) gets a
    chunk of its own, sub-chunked by quantile splits of the second order
    column, so chunk order still follows the full order and a hot tie is
    spread over tasks too.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    n_chunks = _nb(df, n_chunks)
    d = df.withColumn("_ord_num", _order_number(df, order[0]))
    raw = _raw_quantiles(d, "_ord_num", n_chunks)
    heavy = sorted({q for q in raw if raw.count(q) > 1})
    splits = sorted(set(raw) | {math.nextafter(q, math.inf) for q in heavy})
    d = with_bucket(d, F.col("_ord_num"), splits, "_b0")
    chunk = F.col("_b0").cast("bigint")
    if heavy and len(order) > 1:
        in_heavy = F.col("_ord_num").isin(*[F.lit(q) for q in heavy])
        tie = d.filter(in_heavy).withColumn("_tie_num", _order_number(df, order[1]))
        tie_splits = quantile_splits(tie, "_tie_num", n_chunks)
        width = len(tie_splits) + 1
        # rows outside the heavy values have a NULL tie image -> sub-chunk 0
        d = with_bucket(d, F.when(in_heavy, _order_number(df, order[1])), tie_splits, "_b1")
        chunk = chunk * width + F.col("_b1")
    d = d.withColumn("_chunk", chunk).drop("_ord_num", "_b0", "_b1")
    okey = F.struct(*order)
    w_loc = Window.partitionBy(*keys, "_chunk").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    d = d.select("*", *[F.last(c, ignorenulls=True).over(w_loc).alias(f"_loc_{c}") for c in cols])
    last_in_chunk = d.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_cl_{c}") for c in cols])
    w_carry = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_chunk.select(*keys, "_chunk", *[F.last(f"_cl_{c}", ignorenulls=True).over(w_carry)
                                                    .alias(f"_car_{c}") for c in cols])
    j = d.join(carry, keys + ["_chunk"])
    if include_current:
        keep = [c for c in df.columns if c not in cols]
        return j.select(*keep, *[F.coalesce(F.col(f"_loc_{c}"), F.col(f"_car_{c}")).alias(c) for c in cols])
    return j.select(*df.columns, *[F.coalesce(F.col(f"_loc_{c}"), F.col(f"_car_{c}")).alias(f"prev_{c}")
                                   for c in cols])
