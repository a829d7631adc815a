"""Source / sink round trips and the remaining joins and streams
(S3 S5 S6 S8 S10 S11 S14 S19-S22, J8, R4, R6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_long
from ..operators import catalog as K
from ..operators import monitor as M
from ..session import scratch_path
from ..sources import io as IO
from ..sources import views as V
from ..streaming import jobs as J
from .monitoring import metrics_long_sql
from .registry import register
from ..streaming import routing as RT
from .sqltext import oracle

MESSAGE_SCHEMA = ("event_id bigint, customer_id bigint, event_type string, session_id string, "
                  "event_timestamp string, value double, props struct<k: bigint>")


def event_messages(t) -> DataFrame:
    """Kafka-shaped records (topic, timestamp, value bytes) built from the
    behaviour events: JSON with a nested `props` object (FIXTURES.md §4)."""
    ev = V.behavior_events(t, props=True)
    body = F.struct("event_id", "customer_id", "event_type", "session_id",
                    F.col("event_timestamp").cast("string").alias("event_timestamp"), "value",
                    F.from_json("props", "k bigint").alias("props"))
    topic = F.when(F.col("event_type") == "purchase", "transactions").otherwise("customer_events")
    return ev.select(topic.alias("topic"), F.col("event_timestamp").cast("timestamp").alias("timestamp"),
                     F.to_json(body).cast("binary").alias("value"))


@register("json_events_flattened", "S3 S5 S14", oracle("""
SELECT e.topic, CAST(b.event_id AS BIGINT) AS event_id, CAST(b.customer_id AS BIGINT) AS customer_id, b.event_type,
  b.session_id, b.value, CAST(json_extract(ev.props, '$.k') AS BIGINT) AS "props.k"
FROM behavior_events b JOIN events ev ON ev.event_id = b.event_id,
LATERAL (SELECT CASE WHEN b.event_type = 'purchase' THEN 'transactions' ELSE 'customer_events' END AS topic) e""",
                                                   ["behavior_events"]))
def q_json_events(t):
    flat = IO.decode_json(event_messages(t), MESSAGE_SCHEMA, keep=("topic",))
    return flat.select("topic", "event_id", "customer_id", "event_type", "session_id", "value", "`props.k`")


@register("json_events_window", "S4 S5", oracle("""
SELECT CAST(b.event_timestamp AS VARCHAR) AS timestamp, CAST(b.event_id AS BIGINT) AS event_id,
  CAST(b.customer_id AS BIGINT) AS customer_id, b.event_type, b.value,
  CAST(json_extract(ev.props, '$.k') AS BIGINT) AS "props.k"
FROM behavior_events b JOIN events ev ON ev.event_id = b.event_id
WHERE b.event_timestamp >= TIMESTAMP '2024-01-10 00:00:00'
  AND b.event_timestamp < TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 604800 SECOND""", ["behavior_events"]))
def q_json_window(t):
    path = scratch_path(t.spark, "landed-messages")
    event_messages(t).write.parquet(path)
    raw = IO.read_message_window(t.spark, path, "2024-01-10 00:00:00", 7 * 24 * 3600)
    flat = IO.decode_json(raw, MESSAGE_SCHEMA, keep=("timestamp",))
    return flat.select(F.col("timestamp").cast("timestamp_ntz").cast("string").alias("timestamp"),
                       "event_id", "customer_id", "event_type", "value", "`props.k`")


# Records by the last digit of their event: 3 cut short, 5 of a topic without a table, 7 without a value, 9 without a customer.
_BROKEN_SQL = """CASE event_id % 10 WHEN 3 THEN 'undecodable' WHEN 5 THEN 'unknown topic' WHEN 7 THEN 'no value' WHEN 9 THEN 'missing customer_id' ELSE '' END"""


@register("routed_landing", "S3 S14", oracle(f"""
WITH b AS (SELECT *, {_BROKEN_SQL} AS error, CASE WHEN event_type = 'purchase' THEN 'transactions' ELSE 'customer_events' END AS topic FROM behavior_events)
SELECT CASE WHEN error = '' THEN topic ELSE '_rejects' END AS landed_in, error, CAST(COUNT(*) AS BIGINT) AS records,
  CAST(SUM(CASE WHEN error = '' THEN event_id END) AS BIGINT) AS event_ids, ROUND(SUM(CASE WHEN error = '' THEN value END), 2) AS value
FROM b GROUP BY 1, 2""", ["behavior_events"]))
def q_routed(t):
    """Two topics and some broken records, landed by a stream in several micro-batches: what each table got."""
    digit = F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("bigint") % 10
    text = F.col("value").cast("string")
    m = event_messages(t).withColumn("digit", digit)
    m = m.select(F.when(F.col("digit") == 5, "audit_log").otherwise(F.col("topic")).alias("topic"), "timestamp",
                 F.when(F.col("digit") == 3, F.substring(text, F.lit(1), F.length(text) - 1))
                 .when(F.col("digit") == 9, F.regexp_replace(text, '"customer_id"', '"customer"'))
                 .when(F.col("digit") != 7, text).cast("binary").alias("value"))
    src, out = scratch_path(t.spark, "mixed-messages"), scratch_path(t.spark, "routed")
    m.repartition(6).write.parquet(src)
    stream = t.spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(src)
    topics = ("transactions", "customer_events")
    RT.land(RT.route(stream, dict.fromkeys(topics, MESSAGE_SCHEMA), dict.fromkeys(topics, ["customer_id"])), out, scratch_path(t.spark, "routed-ckpt")).awaitTermination()
    rows = RT.read_rejects(t.spark, out).select(F.lit("_rejects").alias("landed_in"), "error", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"))
    for topic in topics:
        rows = rows.unionByName(RT.read_topic(t.spark, out, topic).select(F.lit(topic).alias("landed_in"), F.lit("").alias("error"), "event_id", "value"))
    return rows.groupBy("landed_in", "error").agg(F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("event_ids"), F.round(F.sum("value"), 2).alias("value"))


TX_COLUMNS = "transaction_id long, customer_id long, order_amount double, payment_method string"
TX_SUM = "SUM(transaction_id % 1009 * (customer_id % 97)) + SUM(length(payment_method)), CAST(SUM(order_amount) AS DOUBLE)"


@register("sink_roundtrip", "S6 S8 S10 S11 S16 S19 S20 S21 S22", oracle(f"""
WITH tx AS (SELECT COUNT(*) AS n, {TX_SUM.replace(', CAST', ' AS c, CAST')} AS v FROM transactions),
r AS (SELECT 'csv' AS artifact, n AS rows, c AS checksum, v AS total FROM tx
UNION ALL SELECT 'parquet', n, c, v FROM tx
UNION ALL SELECT 'json', n, c, v FROM tx
UNION ALL SELECT 'appended_twice', 2 * n, 2 * c, 2 * v FROM tx
UNION ALL SELECT 'year_month_day', COUNT(*), SUM(year(order_date) * 372 + month(order_date) * 31 + day(order_date)), SUM(CAST(order_amount AS DOUBLE)) FROM transactions
UNION ALL SELECT 'prediction_log', COUNT(*), SUM(customer_id), SUM(churn_probability) FROM predictions
UNION ALL SELECT 'feedback', COUNT(*), SUM(customer_id), SUM(actual_churn * 2 + CAST(churn_probability > 0.5 AS INTEGER)) FROM predictions
UNION ALL SELECT 'retrain_log', COUNT(DISTINCT segment), COUNT(*), SUM(churn_probability) FROM predictions
UNION ALL SELECT 'metrics', 1, COUNT(*), SUM(value) FROM ({metrics_long_sql('predictions')}))
SELECT artifact, CAST(rows AS BIGINT) AS rows, CAST(checksum AS BIGINT) AS checksum, ROUND(total, 4) AS total FROM r""",
                                                               ["transactions", "predictions"]))
def q_sink_roundtrip(t):
    """Every sink written and read back; rows, a checksum of keys and texts, and the sum of the values."""
    spark = t.spark
    tx = V.transactions(t, lines=False).select("transaction_id", "customer_id", "order_amount", "payment_method", "order_date")
    plain = tx.drop("order_date")
    root = scratch_path(spark, "sinks")
    IO.write(plain, f"{root}/tx_csv", "csv", "overwrite")
    IO.write(plain, f"{root}/tx.parquet", "parquet", "overwrite")
    IO.write(plain, f"{root}/tx_json", "json", "error")
    IO.write(plain, f"{root}/tx_json", "json", "ignore")  # no-op on an existing folder
    for _ in range(2):
        IO.write(plain, f"{root}/twice.parquet", "parquet", "append")
    IO.save_to_datalake_ymd(tx, root, "tx", "order_date")
    pred = V.predictions(t).withColumn("scored_at", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    IO.log_predictions(pred, f"{root}/prediction_log")
    IO.intake_feedback(pred.select("customer_id", F.col("actual_churn").alias("actual"),
                                   (F.col("churn_probability") > 0.5).cast("int").alias("predicted")),
                       f"{root}/feedback", "2001-02-01 00:00:00")
    IO.log_retraining_trigger(pred.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("churn_probability").alias("p")),
                              f"{root}/retrain_log")
    IO.append_metrics(M.metrics_long(V.predictions(t), "actual_churn", "churn_probability"), f"{root}/metrics", "v1", "2001-02-01 00:00:00")

    def told(name, df, checksum, total, rows="COUNT(*)"):
        return df.selectExpr(f"CAST({rows} AS BIGINT) AS rows", f"CAST({checksum} AS BIGINT) AS checksum", f"ROUND(CAST({total} AS DOUBLE), 4) AS total") \
            .select(F.lit(name).alias("artifact"), "*")

    keys, amount = TX_SUM.split(", CAST")
    parts = [told(name, df, keys, "CAST" + amount) for name, df in (
        ("csv", IO.read_csv(spark, f"{root}/tx_csv", TX_COLUMNS)), ("parquet", IO.read_auto(spark, f"{root}/tx.parquet")),
        ("json", IO.read_auto(spark, f"{root}/tx_json", TX_COLUMNS)), ("appended_twice", IO.read_parquet(spark, f"{root}/twice.parquet")))]
    return reduce(DataFrame.unionByName, [
        *parts,
        told("year_month_day", spark.read.parquet(f"{root}/raw/tx"), "SUM(year * 372 + month * 31 + day)", "SUM(CAST(order_amount AS DOUBLE))"),
        told("prediction_log", spark.read.parquet(f"{root}/prediction_log"), "SUM(customer_id)", "SUM(churn_probability)"),
        told("feedback", spark.read.parquet(f"{root}/feedback"), "SUM(customer_id)", "SUM(actual * 2 + predicted)"),
        told("retrain_log", IO.read_auto(spark, f"{root}/retrain_log", "segment string, n long, p double"), "SUM(n)", "SUM(p)"),
        told("metrics", spark.read.parquet(f"{root}/metrics"), "SUM(size(metrics))",
             "SUM(aggregate(map_values(metrics), CAST(0 AS DOUBLE), (a, x) -> a + x))")])


@register("prediction_feedback_join", "J8", oracle("""
WITH l AS (SELECT DISTINCT customer_id FROM transactions WHERE order_date >= TIMESTAMP '2001-01-01' - INTERVAL 366 DAY
             AND order_date < TIMESTAMP '2001-01-01'),
f AS (SELECT DISTINCT customer_id FROM transactions WHERE order_date >= TIMESTAMP '2001-01-01'
        AND order_date < TIMESTAMP '2001-01-01' + INTERVAL 30 DAY),
g AS (SELECT l.customer_id, CASE WHEN f.customer_id IS NULL THEN 1 ELSE 0 END AS churn FROM l LEFT JOIN f USING (customer_id))
SELECT CAST(p.customer_id AS BIGINT) AS customer_id, p.churn_probability, CAST(p.churn_probability > 0.5 AS BIGINT) AS predicted,
  CAST(g.churn AS BIGINT) AS actual FROM predictions p JOIN g ON g.customer_id = p.customer_id""",
                                                      ["transactions", "predictions"]))
def q_feedback_join(t):
    truth = K.churn_labels(V.transactions(t, lines=False), "2001-01-01 00:00:00", 366, 30)
    p = V.predictions(t).select("customer_id", "churn_probability")
    return p.join(truth, "customer_id").select(
        as_long("customer_id").alias("customer_id"), "churn_probability",
        as_long(F.col("churn_probability") > 0.5).alias("predicted"), F.col("churn").alias("actual"))


@register("stream_prediction_monitor", "R6 M12", oracle("""
WITH r AS (SELECT LEAST(FLOOR(churn_probability * 10), 9) AS bin, COUNT(*) AS rn FROM pref GROUP BY 1),
d AS (SELECT DATE '2001-01-01' + CAST(customer_id % 5 AS INTEGER) AS day, LEAST(FLOOR(churn_probability * 10), 9) AS bin FROM predictions),
c AS (SELECT day, bin, COUNT(*) AS cn FROM d GROUP BY 1, 2),
g AS (SELECT day, CAST(b AS DOUBLE) AS bin FROM (SELECT DISTINCT day FROM d), range(0, 10) t(b)),
j AS (SELECT g.day, COALESCE(rn, 0) / (SELECT SUM(rn) FROM r) AS p, COALESCE(cn, 0) / SUM(COALESCE(cn, 0)) OVER (PARTITION BY g.day) AS q
      FROM g LEFT JOIN r ON r.bin = g.bin LEFT JOIN c ON c.day = g.day AND c.bin = g.bin),
s AS (SELECT day, SQRT(SUM(POW(SQRT(p) - SQRT(q), 2)) / 2) AS h FROM j GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, ROUND(h, 6) AS hellinger, CAST(h > 0.1 AS BIGINT) AS prediction_drift FROM s""",
                                                       ["predictions"], pref=V.predictions_at_sql("2000-01-01 00:00:00")))
def q_stream_monitor(t):
    """Scores of five days, two files a batch, so that days come in several batches."""
    spark = t.spark
    src = scratch_path(spark, "scores")
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("customer_id") % 5).cast("int"))
    cur = V.predictions(t).withColumn("scored_at", day.cast("timestamp"))
    cur.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(cur.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = scratch_path(spark, "score-monitor")
    q = (stream.writeStream.foreachBatch(J.monitor_prediction_distribution(out, "scored_at"))
         .option("checkpointLocation", scratch_path(spark, "ckpt-monitor")).trigger(availableNow=True).start())
    q.awaitTermination()
    ref = V.predictions_at(t, "2000-01-01 00:00:00")
    return J.daily_prediction_drift(ref, spark.read.parquet(out)).withColumn("day", F.col("day").cast("string"))


@register("stream_scoring", "R4 P2")
def q_stream_scoring(t):
    from . import modeling as MD
    spark = t.spark
    d, _, params, feats = MD._fit_inputs(t)
    model = MD.fitted_baseline(d)
    src = scratch_path(spark, "score-events")
    ev = V.behavior_events(t).select("customer_id", "event_timestamp")
    ev.write.parquet(src)
    stream = J.event_time(spark.readStream.schema(ev.schema).parquet(src))
    scored = J.score_stream(stream, feats, model, params=params).select("customer_id", "event_timestamp", "churn_probability")
    out = scratch_path(spark, "stream-scores")
    q = (scored.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ckpt-scoring")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
