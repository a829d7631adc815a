"""Orders and their lines meet in as many tasks as the lines ask for, with and without pruned lines."""

from pyspark.sql import functions as F

from retainly.sources import views as V
from retainly.sources.tables import Tables


def test_lines_meet_their_orders_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    key = lambda n: F.when(F.col("id") % 17 != 0, F.col("id") % n)  # noqa: E731  repeated and null
    tables = {
        "orders": spark.range(90).select(key(70).alias("o_orderkey"), key(9).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") * 1.5).alias("o_totalprice"),
                                         (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id"))).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": spark.range(400).select(key(80).alias("l_orderkey"), key(11).alias("l_partkey"), F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"),
                                            F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"), (F.col("id") % 9 / 100).alias("l_discount")),
        "part": spark.range(13).select((F.col("id") % 10).alias("p_partkey"), F.concat(F.lit("type "), (F.col("id") % 4).cast("string")).alias("p_type")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    monkeypatch.setattr(V, "TASK_LINES", 20)
    got = V.transactions(t)
    assert got.rdd.getNumPartitions() == 20
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    some = F.col("o_orderdate") < F.lit("2000-03-01").cast("timestamp_ntz")
    pruned = rows(V.transactions(t, where=some))
    assert len(pruned) == 60 and rows(V.transactions(t, where=some, prune=False)) == pruned
    assert rows(got.where("order_date < timestamp_ntz'2000-03-01'")) == pruned
