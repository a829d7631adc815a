"""Structured Streaming jobs.

Each job is a function from a streaming DataFrame to a streaming
DataFrame (or a started query); sources are any `readStream` (Kafka in
production, a file folder in tests). State is bounded by watermarks; sinks
are idempotent per micro-batch (file sinks with checkpoints, or
`foreachBatch` writes keyed by batch id), so a restarted query resumes from
its checkpoint without double counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.drift import hellinger_by, score_bins
from ..operators.score import prepare_features
from ..sources.io import decode_json


def event_time(df: DataFrame, col: str = "event_timestamp") -> DataFrame:
    """Streams need TIMESTAMP (not timestamp_ntz) for watermarks."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def decode_events(raw: DataFrame, schema, ts: str = "event_timestamp") -> DataFrame:
    """Kafka-shaped records (value: JSON bytes) -> flattened event columns
    with a timestamp that watermarks accept."""
    return event_time(decode_json(raw, schema, keep=("topic",)), ts)


def land_raw_events(stream: DataFrame, path: str, checkpoint: str, ts: str = "event_timestamp",
                    trigger_available_now: bool = True):
    """Events -> date-partitioned parquet (exactly-once file sink)."""
    out = stream.withColumn("date", F.date_format(F.col(ts), "yyyy-MM-dd"))
    w = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("date").outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="1 minute")
    return w.start()


def hourly_behavior_counters(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour",
                             ts: str = "event_timestamp") -> DataFrame:
    """R2: per customer and tumbling window: page views, add-to-cart,
    purchases, all events (F14 on a stream). State is dropped once the
    watermark passes a window's end."""
    et = F.col("event_type")
    return (events.withWatermark(ts, watermark)
            .groupBy(F.window(F.col(ts), window).alias("w"), "customer_id")
            .agg(F.count_if(et == "page_view").alias("page_views"),
                 F.count_if(et == "add_to_cart").alias("add_to_cart_events"),
                 F.count_if(et == "purchase").alias("purchase_events"),
                 F.count(F.lit(1)).alias("events")))


def customer_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 day", ts: str = "event_timestamp") -> DataFrame:
    """Sessions of each customer: events less than `gap` apart are one
    session, also where a late one joins two. customer_id, session_start,
    duration_seconds (first to last event), page_views, events. On a stream
    (append mode) a session is given out once the watermark has passed its end,
    and its state goes; events that come after that are dropped and counted
    (`late_events`). On a table it is the batch twin. Events without a customer
    make sessions of a null one, for the reader to leave out: left out here,
    they would be dropped before they move the watermark."""
    s = (events.withWatermark(ts, watermark).groupBy(F.session_window(F.col(ts), gap).alias("s"), "customer_id")
         .agg(F.min(ts).alias("session_start"), F.max(ts).alias("_last"), F.count_if(F.col("event_type") == "page_view").alias("page_views"), F.count(F.lit(1)).alias("events")))
    seconds = (F.unix_micros("_last") - F.unix_micros("session_start")) / 1_000_000
    return s.select("customer_id", "session_start", seconds.alias("duration_seconds"), "page_views", "events")


def late_events(query) -> int:
    """Events of a stream's recent micro-batches that came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def dedup_events(events: DataFrame, watermark: str = "10 minutes", keys=("customer_id", "event_timestamp"),
                 ts: str = "event_timestamp") -> DataFrame:
    """Duplicates of (customer, timestamp) dropped within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def score_stream(events: DataFrame, features: DataFrame, model, key: str = "customer_id",
                 params: DataFrame | None = None) -> DataFrame:
    """Continuous scoring: stream-static join with the latest feature
    table (every event is scored; features of an unknown customer are absent,
    that is 0), scaling with the training parameters, then the fitted pipeline
    model (same code path as batch)."""
    from pyspark.ml.functions import vector_to_array
    names = [c for c in features.columns if c != key]
    j = prepare_features(events.select(key, "event_timestamp").join(features, key, "left"), names, params)
    return model.transform(j).withColumn("churn_probability", vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability")


def rolling_error_rate(feedback: DataFrame, watermark: str = "1 day", window: str = "7 days",
                       slide: str = "1 day", ts: str = "received_at") -> DataFrame:
    """Share of wrong predictions per sliding 7-day window."""
    wrong = (F.col("predicted") != F.col("actual")).cast("int")
    return (feedback.withWatermark(ts, watermark).groupBy(F.window(F.col(ts), window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error_rate")))


def monitor_prediction_distribution(path: str, day: str, score: str = "churn_probability"):
    """A `foreachBatch` function that counts each micro-batch's scores per
    (day, bin) into `batch_id=N` (overwrite: a replayed batch replaces itself).
    A day may come in several batches; `daily_prediction_drift` adds them up."""
    def run(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.to_date(day).alias("day"), score_bins(score).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return run


def daily_prediction_drift(reference: DataFrame, counts: DataFrame, score: str = "churn_probability") -> DataFrame:
    """Hellinger distance (M12) of each day's scores from the reference
    scores, whose histogram is counted once, not per batch."""
    hist = reference.groupBy(score_bins(score).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return hellinger_by(hist, counts, "day")


def upsert_batches(path: str):
    """`foreachBatch` sink for update-mode aggregates: every micro-batch is
    written to its own `batch_id=N` folder with overwrite, so a batch replayed
    after a failure replaces its own output (idempotent); readers keep the
    latest version per key (`latest_versions`)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return run


def latest_versions(df: DataFrame, keys) -> DataFrame:
    """Latest row per key across micro-batch folders (max_by batch id)."""
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])
