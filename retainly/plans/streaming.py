"""Streaming queries, checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import as_long
from ..session import scratch_path
from ..sources import views as V
from ..streaming import compacted as CS
from ..streaming import jobs as J
from .registry import register
from .sinks import MESSAGE_SCHEMA, event_messages
from .sqltext import oracle


def _event_files(t):
    """The behaviour events written as one folder per day (a file-source
    stream input derived from the events table)."""
    path = scratch_path(t.spark, "events-by-day")
    ev = V.behavior_events(t).withColumn("day", F.to_date("event_timestamp"))
    ev.write.mode("overwrite").partitionBy("day").parquet(path)
    return path, ev.drop("day").schema


def _stream(t, path, schema):
    """A backlog is one micro-batch: a watermark only drops rows that come after
    the batch that raised it, so nothing depends on the files' number or order."""
    return J.event_time(t.spark.readStream.schema(schema).parquet(path))


@register("stream_hourly_counters", "R2 R1 S3", oracle("""
SELECT CAST(date_trunc('hour', event_timestamp) AS VARCHAR) AS window_start, CAST(customer_id AS BIGINT) AS customer_id,
  CAST(COUNT(*) FILTER (WHERE event_type = 'page_view') AS BIGINT) AS page_views,
  CAST(COUNT(*) FILTER (WHERE event_type = 'add_to_cart') AS BIGINT) AS add_to_cart_events,
  CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchase_events,
  CAST(COUNT(*) AS BIGINT) AS events
FROM behavior_events GROUP BY 1, 2""", ["behavior_events"]))
def q_stream_hourly(t):
    path, schema = _event_files(t)
    agg = J.hourly_behavior_counters(_stream(t, path, schema))
    out = scratch_path(t.spark, "hourly-counters")
    q = (agg.writeStream.outputMode("update").foreachBatch(CS.compacting_sink(out, ["w", "customer_id"]))
         .option("checkpointLocation", scratch_path(t.spark, "ckpt-hourly")).trigger(availableNow=True).start())
    q.awaitTermination()
    res = CS.current(t.spark, out, ["w", "customer_id"], agg.schema)
    return res.select(F.col("w.start").cast("timestamp_ntz").cast("string").alias("window_start"),
                      as_long("customer_id").alias("customer_id"), as_long("page_views").alias("page_views"),
                      as_long("add_to_cart_events").alias("add_to_cart_events"),
                      as_long("purchase_events").alias("purchase_events"), as_long("events").alias("events"))


@register("stream_sessions", "R2 C58", oracle("""
WITH g AS (SELECT *, CASE WHEN event_timestamp - LAG(event_timestamp) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM behavior_events WINDOW w AS (PARTITION BY customer_id ORDER BY event_timestamp)),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY customer_id ORDER BY event_timestamp, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM
  (SELECT * FROM g)),
p AS (SELECT customer_id, nth, COUNT(*) AS events, COUNT(*) FILTER (WHERE event_type = 'page_view') AS views,
  date_diff('microsecond', MIN(event_timestamp), MAX(event_timestamp)) / 1000000.0 AS seconds FROM s GROUP BY 1, 2)
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(COUNT(*) AS BIGINT) AS sessions, CAST(SUM(events) AS BIGINT) AS events,
  ROUND(SUM(views) / COUNT(*), 6) AS page_views_per_session, ROUND(CAST(SUM(seconds) AS DOUBLE) / COUNT(*), 3) AS average_session_seconds
FROM p GROUP BY customer_id""", ["behavior_events"]))
def q_stream_sessions(t):
    """Sessions by a 30-minute gap, given out in append mode; a later event without a customer closes the last ones."""
    path, schema = _event_files(t)
    out, checkpoint = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "ckpt-sessions")

    def run():
        s = J.customer_sessions(_stream(t, path, schema))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    end = t.spark.read.parquet(path).agg((F.max("event_timestamp") + F.expr("INTERVAL 3 DAYS")).alias("event_timestamp"))
    end = end.select(*[F.col(f.name) if f.name == "event_timestamp" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.to_date("event_timestamp").alias("day"))
    end.write.mode("append").partitionBy("day").parquet(path)
    run()
    per = t.spark.read.parquet(out).where("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("events").alias("e"), F.sum("page_views").alias("v"), F.sum(F.col("duration_seconds").cast("decimal(18,6)")).alias("d"))
    return per.select(as_long("customer_id").alias("customer_id"), as_long("n").alias("sessions"), as_long("e").alias("events"),
                      F.round(F.col("v") / F.col("n"), 6).alias("page_views_per_session"), F.round(F.col("d").cast("double") / F.col("n"), 3).alias("average_session_seconds"))


@register("stream_dedup_landing", "R3 R1 S15", oracle("""
SELECT CAST(event_timestamp AS DATE)::VARCHAR AS date, CAST(COUNT(*) AS BIGINT) AS events
FROM (SELECT DISTINCT customer_id, event_timestamp FROM behavior_events) GROUP BY 1""", ["behavior_events"]))
def q_stream_dedup(t):
    path = scratch_path(t.spark, "messages")
    messages = event_messages(t)
    messages.repartition(12).write.parquet(path)  # in no order of time
    s = J.decode_events(t.spark.readStream.schema(messages.schema).parquet(path), MESSAGE_SCHEMA)
    d = J.dedup_events(s, "1 day").select("customer_id", "event_timestamp")
    out = scratch_path(t.spark, "landed")
    q = J.land_raw_events(d, out, scratch_path(t.spark, "ckpt-land"))
    q.awaitTermination()
    landed = t.spark.read.parquet(out)
    return landed.groupBy(F.col("date").cast("string").alias("date")).agg(as_long(F.count(F.lit(1))).alias("events"))


@register("stream_rolling_error", "R5 S22", oracle("""
WITH f AS (SELECT customer_id, CAST(churn_probability > 0.5 AS INTEGER) AS predicted, actual_churn AS actual,
             TIMESTAMP '2001-01-01' + (customer_id % 30) * INTERVAL 1 DAY AS received_at FROM predictions),
w AS (SELECT date_trunc('day', received_at) - k * INTERVAL 1 DAY AS ws, predicted, actual FROM f, range(0, 7) t(k))
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(COUNT(*) AS BIGINT) AS n,
  ROUND(AVG(CAST(predicted <> actual AS INTEGER)), 6) AS error_rate FROM w GROUP BY ws""", ["predictions"]))
def q_stream_error(t):
    fb = V.predictions(t).select("customer_id", (F.col("churn_probability") > 0.5).cast("int").alias("predicted"),
                                 F.col("actual_churn").alias("actual"),
                                 (F.lit("2001-01-01").cast("timestamp_ntz")
                                  + F.make_dt_interval(F.col("customer_id") % 30)).alias("received_at"))
    path = scratch_path(t.spark, "feedback")
    fb.write.mode("overwrite").parquet(path)
    s = t.spark.readStream.schema(fb.schema).parquet(path).withColumn("received_at", F.col("received_at").cast("timestamp"))
    agg = J.rolling_error_rate(s)
    out = scratch_path(t.spark, "error-rate")
    q = (agg.writeStream.outputMode("update").foreachBatch(CS.compacting_sink(out, ["w"]))
         .option("checkpointLocation", scratch_path(t.spark, "ckpt-err")).trigger(availableNow=True).start())
    q.awaitTermination()
    res = CS.current(t.spark, out, ["w"], agg.schema)
    return res.select(F.col("w.start").cast("timestamp_ntz").cast("string").alias("window_start"),
                      as_long("n").alias("n"), F.round("error_rate", 6).alias("error_rate"))


@register("datalake_inventory", "S9 S15 S16 S7", oracle("""
SELECT CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS date, CAST(COUNT(*) AS BIGINT) AS rows
FROM behavior_events WHERE CAST(event_timestamp AS DATE) >= DATE '2024-01-10' GROUP BY 1""", ["behavior_events"]))
def q_inventory(t):
    from ..sources import io as IO
    root = scratch_path(t.spark, "lake")
    IO.save_to_datalake(V.behavior_events(t), root, "customer_events", "event_timestamp")
    pruned = IO.read_datalake(t.spark, root, "customer_events", start="2024-01-10")
    inv = IO.lake_inventory(pruned)
    date = F.regexp_extract("file_path", r"date=(\d{4}-\d{2}-\d{2})", 1)
    return inv.groupBy(date.alias("date")).agg(as_long(F.sum("rows")).alias("rows"))
