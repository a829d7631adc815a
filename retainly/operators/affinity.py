"""Learned category affinity (C59) by blocked implicit-feedback factorisation.

How often a customer bought from a category is taken as confidence in a
preference; alternating least squares (`pyspark.ml.recommendation.ALS`, both
sides in blocks) gives every customer and every category a short vector, whose
product is the affinity, also for categories that the customer never bought.

Null customers, null categories and counts below one are no preferences.
Customer ids must fit 32 bits, which the learner needs; `fit` checks it.
The input is laid out by customer in a fixed order, so the same rows and seed
give the same vectors up to the rounding of single precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from ..session import materialize

RANK, ITERATIONS, REGULARISATION, CONFIDENCE, SEED = 8, 10, 0.1, 5.0, 42
BLOCK = 1_000  # categories whose vectors meet the customers in one pass


def preferences(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """customer_id, category, n: order lines of each customer and category."""
    j = tx.select("customer_id", "transaction_id").join(lines, F.col("transaction_id") == F.col("l_orderkey"))
    return (j.where(F.col("customer_id").isNotNull() & F.col("p_type").isNotNull())
            .groupBy("customer_id", F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")))


def numbered(prefs: DataFrame) -> DataFrame:
    """category, item: categories in order from 0. Its rows are those of the catalogue."""
    # numbers by range partitions: each one's size, then places within it
    cats = materialize(prefs.select("category").distinct().repartitionByRange("category")
                       .withColumn("part", F.spark_partition_id()))
    sizes = cats.groupBy("part").count()  # a row for each partition
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("category")) - 1
    return cats.withColumn("place", place).join(F.broadcast(before), "part").select(
        "category", (F.col("before") + F.col("place")).cast("int").alias("item"))


def fit(prefs: DataFrame, items: DataFrame, rank: int = RANK, iterations: int = ITERATIONS, seed: int = SEED):
    """(customers: customer_id, vector; categories: category, item, vector) of customer_id, category, n."""
    rows = prefs.where(F.col("customer_id").isNotNull() & (F.col("n") > 0)).join(items, "category")
    rows = materialize(rows.select("customer_id", "item", F.col("n").cast("float").alias("n"))
                       .repartition("customer_id").sortWithinPartitions("customer_id", "item"))
    low, high = rows.agg(F.min("customer_id"), F.max("customer_id")).first()
    if low is None:
        blank = F.array(F.lit(0.0).cast("float")).alias("vector")
        return rows.select("customer_id", blank), items.limit(0).select("category", "item", blank)
    if low < -(2**31) or high >= 2**31:
        raise ValueError("customer ids beyond 32 bits: number the customers first")
    model = ALS(rank=rank, maxIter=iterations, regParam=REGULARISATION, implicitPrefs=True, alpha=CONFIDENCE, seed=seed,
                userCol="customer_id", itemCol="item", ratingCol="n", checkpointInterval=2).fit(rows)
    customers = model.userFactors.select(F.col("id").cast(prefs.schema["customer_id"].dataType).alias("customer_id"), F.col("features").alias("vector"))
    vectors = model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("vector"))
    return customers, items.join(vectors, "item").select("category", "item", "vector")


def _blocks(items: DataFrame):
    """The rows of a catalogue, at most BLOCK at a time."""
    last = items.agg(F.max("item")).first()[0]
    for low in range(0, -1 if last is None else last + 1, BLOCK):
        yield items.where(F.col("item").between(low, low + BLOCK - 1)).orderBy("item").collect()


def _affinity(vector, other):
    return F.aggregate(F.zip_with(vector, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def _literal(rows, columns):
    """A block's rows as one array of structs."""
    return F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in columns)) for r in rows))


def affinities(customers: DataFrame, categories: DataFrame, top: int = 3) -> DataFrame:
    """customer_id, vector, top: each customer's `top` categories by affinity (ties by name), as structs (affinity, category)."""
    best = F.array().cast("array<struct<loss:double,category:string>>")
    df = customers.withColumn("best", best)
    for rows in _blocks(categories):
        block = _literal(rows, ("category", "vector"))
        scored = F.transform(block, lambda c: F.struct((-_affinity(F.col("vector"), c["vector"])).alias("loss"), c["category"].alias("category")))
        df = df.withColumn("best", F.slice(F.array_sort(F.concat("best", scored)), 1, top))
    named = F.transform("best", lambda b: F.struct((-b["loss"]).alias("affinity"), b["category"].alias("category")))
    return df.select("customer_id", "vector", named.alias("top"))


def held_out(prefs: DataFrame, seed: int = SEED) -> DataFrame:
    """prefs with held: one category of each customer with two or more, by a hash. A customer's rows are at most the catalogue's."""
    own = Window.partitionBy("customer_id")
    at = F.row_number().over(own.orderBy(F.xxhash64("customer_id", "category", F.lit(seed)), "category"))
    return prefs.withColumn("held", (at == 1) & (F.count(F.lit(1)).over(own) > 1))


def holdout_ranking(prefs: DataFrame, rank: int = RANK, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """method, customers, auc: for each customer with a held-out category, the share of the categories it never bought that score
    lower (ties half), averaged. Methods: `learned` vectors, the customer's `share` vector, `popularity` of categories.
    Customers who bought from every category have nothing to rank against and don't count."""
    prefs = materialize(held_out(prefs, seed))
    items = materialize(numbered(prefs))
    train = prefs.where(~F.col("held"))
    customers, categories = fit(train, items, rank, iterations, seed)
    popular = train.groupBy("category").agg(F.sum("n").alias("sold"))
    catalogue = materialize(items.join(categories.select("item", "vector"), "item", "left").join(popular, "category", "left")
                            .select("item", "vector", F.coalesce("sold", F.lit(0)).cast("double").alias("sold")))
    numbers = prefs.join(items, "category").groupBy("customer_id").agg(
        F.max(F.when(F.col("held"), F.col("item"))).alias("held_item"), F.collect_set("item").alias("bought"))
    cases = (numbers.where(F.col("held_item").isNotNull()).join(customers, "customer_id")
             .join(catalogue.select(F.col("item").alias("held_item"), F.col("vector").alias("held_vector"), F.col("sold").alias("held_sold")), "held_item"))
    cases = materialize(cases.withColumn("held_affinity", F.coalesce(_affinity(F.col("vector"), F.col("held_vector")), F.lit(0.0))))

    def won(others, score, held):
        points = F.transform(others, lambda c: F.when(score(c) < held, 1.0).when(score(c) == held, 0.5).otherwise(0.0))
        return F.aggregate(points, F.lit(0.0), lambda s, x: s + x)

    parts = []
    for rows in _blocks(catalogue):
        blank = [0.0] * rank
        block = F.array(*(F.struct(F.lit(r.item).alias("item"), F.lit(r.vector or blank).alias("vector"), F.lit(r.sold).alias("sold")) for r in rows))
        others = F.filter(block, lambda c: ~F.array_contains("bought", c["item"]))
        parts.append(cases.select(
            "customer_id", F.size(others).alias("others"),
            won(others, lambda c: _affinity(F.col("vector"), c["vector"]), F.col("held_affinity")).alias("learned"),
            # neither the held-out category nor the others are in the customer's training rows
            (F.size(others) * 0.5).alias("share"),
            won(others, lambda c: c["sold"], F.col("held_sold")).alias("popularity")))
    methods = ("learned", "share", "popularity")
    if not parts:
        return prefs.limit(0).select(F.lit("").alias("method"), as_long(F.lit(0)).alias("customers"), as_double(F.lit(0.0)).alias("auc"))
    points = reduce(DataFrame.unionByName, parts).groupBy("customer_id").agg(*(F.sum(c).alias(c) for c in ("others", *methods))).where("others > 0")
    row = points.agg(F.count(F.lit(1)).alias("customers"), *(F.avg(F.col(m) / F.col("others")).alias(m) for m in methods))
    return row.select("customers", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("auc")) for m in methods))).alias("x")).select(
        F.col("x.method").alias("method"), as_long("customers").alias("customers"), F.col("x.auc").alias("auc"))
