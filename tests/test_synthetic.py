import numpy as np
from pyspark.sql import functions as F

from retainly.operators import synthetic as S

FEATURES = [f"f{k}" for k in range(8)]


def table(spark, n):
    """Features that follow a few hidden ones, as customers' features do."""
    hidden = spark.range(n).select("id", *[F.randn(10 + k).alias(f"h{k}") for k in range(3)])
    return hidden.select("id", (F.col("id") % 7 != 0).cast("int").alias("y"),
                         *[(F.col(f"h{k % 3}") * (1 + k) + F.col(f"h{(k + 1) % 3}") * (k % 2) + F.randn(30 + k) * 0.2).alias(f) for k, f in enumerate(FEATURES)])


def brute(rows, k):
    x = rows[FEATURES].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {int(i): {int(rows.id[j]) for j in np.argsort(d[r])[:k]} for r, i in enumerate(rows.id)}


def test_neighbours_of_small_classes_are_exact(spark):
    df = table(spark, 300)
    want = brute(df.toPandas(), 5)
    got = {}
    for r in S.neighbours(df, "id", FEATURES, 5).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert got == want


def test_recall_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 250)
    df = table(spark, 3000).cache()
    want, hits = brute(df.toPandas(), 5), 0
    for r in S.neighbours(df, "id", FEATURES, 5).collect():
        hits += r.neighbour in want[r.id]
    assert hits >= 0.9 * 5 * 3000


def test_new_rows_lie_between_two_real_ones(spark):
    df = table(spark, 500).withColumn("f3", F.when(F.col("id") % 5 > 0, F.col("f3"))).cache()
    made = S.synthetic_minority(df, "id", "y", FEATURES, minority=0, copies=3, k=4)
    rows = {r.id: r for r in df.collect()}
    near = brute(df.where("y = 0").fillna(0.0).toPandas(), 4)
    got = made.collect()
    assert len(got) == 3 * sum(r.y == 0 for r in rows.values()) and len({(r.id, r.copy) for r in got}) == len(got)
    for r in got:
        a, b = rows[r.id], rows[r.neighbour]
        assert a.y == b.y == r.y == 0 and r.neighbour in near[r.id] and 0 <= r.share < 1
        assert all(min(a[f] or 0, b[f] or 0) - 1e-9 <= r[f] <= max(a[f] or 0, b[f] or 0) + 1e-9 for f in FEATURES)
    again = {(r.id, r.copy): (r.neighbour, r.f0) for r in S.synthetic_minority(df.repartition(3), "id", "y", FEATURES, minority=0, copies=3, k=4).collect()}
    assert again == {(r.id, r.copy): (r.neighbour, r.f0) for r in got}


def test_equal_rows_and_lonely_ones(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 20)
    same = spark.range(200).select("id", F.lit(1).alias("y"), *[F.lit(2.0).alias(f) for f in FEATURES])
    made = S.synthetic_minority(same, "id", "y", FEATURES, copies=2)
    assert made.count() == 400 and made.where("f0 <> 2.0 or neighbour = id").count() == 0
    assert S.synthetic_minority(same.limit(1), "id", "y", FEATURES).count() == 0 and S.synthetic_minority(same.limit(0), "id", "y", FEATURES).count() == 0


def exact(rows, k):
    """By row the distances and keys of its k nearest others, ties by key."""
    x = rows[FEATURES].to_numpy()
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    found = {}
    for r, i in enumerate(rows.id):
        d = np.round(np.sqrt(((x[r] - x) ** 2).sum(1)), 9)
        found[int(i)] = [(float(d[j]), int(rows.id[j])) for j in np.lexsort((rows.id, d)) if j != r][:k]
    return found


def test_neighbours_are_exact_at_any_size(spark, monkeypatch):
    """Over many leaves and groups the neighbours are those of one block, ties and equal rows included."""
    monkeypatch.setattr(S, "BUCKET", 30)
    monkeypatch.setattr(S, "GROUP", 4)
    monkeypatch.setattr(S, "SIDE", 50)
    steps = [F.round(F.col(f)).alias(f) for f in FEATURES]  # some equal rows and ties
    df = table(spark, 700).select("id", *FEATURES).union(table(spark, 300).select(F.col("id") + 1000, *steps)).union(spark.range(2000, 2200).select("id", *[F.lit(1.0)] * 8)).cache()
    got = {}
    for r in S.neighbours(df, "id", FEATURES, 5).orderBy("id", "nth").collect():
        got.setdefault(r.id, []).append((round(r.distance, 9), r.neighbour))
    want = exact(df.toPandas(), 5)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], rtol=0, atol=2e-9), (i, got[i], want[i])
        assert got[i] == want[i] or i in range(1000, 2000) or {n for _, n in got[i]} & {*range(1000, 2000)}  # there rounding may break a tie


def test_neighbours_of_repeated_rows_and_text_keys(spark):
    df = spark.range(12).select(F.concat(F.lit("k"), F.col("id") % 6).alias("id"), *[((F.col("id") % 6) * (n + 1.0)).alias(f) for n, f in enumerate(FEATURES)])
    got = {(r.id, r.nth): r.neighbour for r in S.neighbours(df, "id", FEATURES, 3).collect()}
    assert [got["k0", n] for n in (1, 2)] == ["k0", "k1"] and ("k0", 3) not in got  # its twin, and one key twice
