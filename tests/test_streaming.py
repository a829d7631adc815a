"""Stream = batch for the windowed behaviour counters (file source, availableNow)."""

import datetime as dt

from pyspark.sql import functions as F

from retainly.session import scratch_path
from retainly.streaming import jobs as J


def test_hourly_counters_stream_equals_batch(spark):
    rows = [(c, t, dt.datetime(2024, 1, 1 + d, h, m)) for d in range(3) for h in (1, 2) for m in (5, 40)
            for c, t in ((1, "page_view"), (2, "purchase"))]
    df = spark.createDataFrame(rows, "customer_id long, event_type string, event_timestamp timestamp")
    src = scratch_path(spark, "test-src")
    df.withColumn("day", F.to_date("event_timestamp")).write.partitionBy("day").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "test-out")
    q = (J.hourly_behavior_counters(stream, watermark="7 days").writeStream.outputMode("update")
         .foreachBatch(J.upsert_batches(out)).option("checkpointLocation", scratch_path(spark, "test-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = J.latest_versions(spark.read.parquet(out), ["w", "customer_id"]) \
        .select(F.col("w.start").alias("s"), "customer_id", "events", "page_views").collect()
    exp = J.hourly_behavior_counters(df, watermark="7 days") \
        .select(F.col("w.start").alias("s"), "customer_id", "events", "page_views").collect()
    assert sorted(got) == sorted(exp) and len(exp) == 12
