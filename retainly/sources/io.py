"""Scans and sinks (S1-S22) as Spark readers / writers.

All paths are folders on shared storage (the cluster's filesystem or object
store); nothing is staged on the driver. Partitioned writes use dynamic
partition overwrite, so re-running one day replaces that day only and a
retried job is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAVE_MODES = ("overwrite", "append", "ignore", "error", "errorifexists")


# ------------------------------------------------------------------ files
def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S8."""
    df.write.mode(mode).parquet(path)


def read_auto(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """`.parquet` paths read as parquet, anything else as JSON (with a
    schema when given). No eager count."""
    fmt = "parquet" if path.rstrip("/").endswith(".parquet") else "json"
    r = spark.read.format(fmt)
    if schema is not None and fmt == "json":
        r = r.schema(schema)
    return r.load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=()) -> None:
    """Any format with save mode overwrite / append / ignore / error."""
    if mode not in SAVE_MODES:
        raise ValueError(f"unknown save mode {mode}")
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)


def lake_inventory(df: DataFrame) -> DataFrame:
    """S9 (re-aimed): files and row counts of a scanned folder, from the
    hidden `_metadata` column — a distributed count, not a driver listing."""
    return df.select(F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_size").alias("file_size")) \
        .groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ lake
def _replace_partitions(df: DataFrame, path: str, by, files: int) -> None:
    """Overwrite the partitions that df has, and no others (an option of this
    write; the session keeps its setting). Rows of one partition are dealt to
    `files` tasks, so it gets that many files however many tasks there were,
    and a day that holds most rows is still written in parallel."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    (df.repartition(*by, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def save_to_datalake(df: DataFrame, root: str, data_type: str, date_col: str, files_per_day: int = 4) -> None:
    """`<root>/raw/<type>/date=YYYY-MM-DD/`, dynamic partition overwrite."""
    out = df.withColumn("date", F.date_format(F.col(date_col), "yyyy-MM-dd"))
    _replace_partitions(out, f"{root.rstrip('/')}/raw/{data_type}", ["date"], files_per_day)


def save_to_datalake_ymd(df: DataFrame, root: str, data_type: str, date_col: str, files_per_day: int = 4) -> None:
    """year=/month=/day= layout."""
    d = F.col(date_col)
    out = df.withColumn("year", F.year(d)).withColumn("month", F.month(d)).withColumn("day", F.dayofmonth(d))
    _replace_partitions(out, f"{root.rstrip('/')}/raw/{data_type}", ["year", "month", "day"], files_per_day)


def read_datalake(spark: SparkSession, root: str, data_type: str, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Partition-pruned read of the raw zone (filter on the `date` partition)."""
    df = spark.read.parquet(f"{root.rstrip('/')}/raw/{data_type}")
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") <= F.lit(end))
    return df


# ------------------------------------------------------------------ feature store
def store_features(df: DataFrame, path: str, version: str) -> None:
    """Versioned feature set, one partition per version."""
    (df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))


def retrieve_features(spark: SparkSession, path: str, version: str, ids: DataFrame | None = None,
                      key: str = "customer_id") -> DataFrame:
    """Partition filter on the version, semi join with an id table."""
    df = spark.read.parquet(path).filter(F.col("version") == version)
    return df.join(ids.select(key), key, "left_semi") if ids is not None else df


# ------------------------------------------------------------------ logs
def log_predictions(df: DataFrame, path: str, ts_col: str = "scored_at") -> None:
    """Append-only prediction log partitioned by log date."""
    df.withColumn("log_date", F.to_date(F.col(ts_col))).write.mode("append").partitionBy("log_date").parquet(path)


def log_retraining_trigger(df: DataFrame, path: str) -> None:
    """Retrain decisions appended as JSON lines."""
    df.write.mode("append").json(path)


def append_metrics(metrics_long: DataFrame, path: str, model_version: str, ts: str, partition: str = "all") -> None:
    """Metric history rows (model_version, ts, data_partition, metrics map)."""
    row = metrics_long.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    row.select(F.lit(model_version).alias("model_version"), F.lit(ts).cast("timestamp_ntz").alias("ts"),
               F.lit(partition).alias("data_partition"), "metrics").write.mode("append").parquet(path)


def intake_feedback(df: DataFrame, path: str, received_at: str | None = None) -> None:
    """Ground-truth feedback appended with its receive time."""
    ts = F.lit(received_at).cast("timestamp_ntz") if received_at else F.current_timestamp()
    df.withColumn("received_at", ts).write.mode("append").parquet(path)


# ------------------------------------------------------------------ databases
def jdbc_options(url: str, query: str | None = None, table: str | None = None, user: str | None = None,
                 password: str | None = None, driver: str | None = None, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000) -> dict:
    """S1-S2 options. A `query` reads through one connection; at scale give
    `table` + partition column and bounds, so Spark opens `num_partitions`
    parallel range reads (the predicate pushdown goes to the database)."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query / table")
    o = {"url": url, "fetchsize": str(fetch_size)}
    if query is not None:
        if partition_column:
            raise ValueError("partitioned reads need `table` (Spark wraps it in range predicates)")
        o["query"] = query
    else:
        o["dbtable"] = table
        if partition_column:
            if None in (lower, upper, num_partitions):
                raise ValueError("partitioned read needs lower, upper and num_partitions")
            o.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                     numPartitions=str(num_partitions))
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            o[k] = v
    return o


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    """S1 (PostgreSQL) / S2 (MySQL): the URL selects the database; the JDBC
    driver jar must be on the cluster classpath."""
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()


# ------------------------------------------------------------------ kafka
def kafka_options(bootstrap: str, topics, max_offsets_per_trigger: int | None = None,
                  starting: str = "latest", start_ts: int | None = None, end_ts: int | None = None) -> dict:
    """S3 / S4 / S14 options: several topics in one subscription; a message
    cap per micro-batch; a time-bounded batch read by timestamps (ms)."""
    o = {"kafka.bootstrap.servers": bootstrap,
         "subscribe": topics if isinstance(topics, str) else ",".join(topics)}
    if max_offsets_per_trigger:
        o["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    if start_ts is not None:
        o["startingTimestamp"] = str(int(start_ts))
    else:
        o["startingOffsets"] = starting
    if end_ts is not None:
        o["endingTimestamp"] = str(int(end_ts))
    return o


def decode_json(raw: DataFrame, schema: StructType | str, keep=("topic", "timestamp")) -> DataFrame:
    """Kafka `value` bytes -> JSON struct -> flattened columns with
    dotted names (json_normalize style), driven by the schema."""
    parsed = raw.select(*keep, F.from_json(F.col("value").cast("string"), schema).alias("m"))
    return parsed.select(*keep, *flatten_columns(parsed.schema["m"].dataType, "m"))


def flatten_columns(schema: StructType, prefix: str, name_prefix: str = ""):
    """Recursive struct flattening: `m.a.b` becomes column `a.b`."""
    cols = []
    for f in schema.fields:
        path, name = f"{prefix}.`{f.name}`", f"{name_prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            cols += flatten_columns(f.dataType, path, name + ".")
        else:
            cols.append(F.col(path).alias(name))
    return cols


def read_kafka_stream(spark: SparkSession, **kw) -> DataFrame:
    """Continuous read (needs the Kafka connector on the classpath)."""
    return spark.readStream.format("kafka").options(**kafka_options(**kw)).load()


def read_kafka_batch(spark: SparkSession, **kw) -> DataFrame:
    """Time-bounded batch read of the topics, from the earliest offset
    where no start is given (a batch read can't begin at the latest)."""
    return spark.read.format("kafka").options(**kafka_options(**{"starting": "earliest", **kw})).load()


def read_message_window(spark: SparkSession, path: str, start: str, duration_seconds: int) -> DataFrame:
    """S4 over landed Kafka records (topic, timestamp, value): the records of
    [start, start + duration), the bounds `startingTimestamp` /
    `endingTimestamp` give a batch Kafka read. The bound is a filter on the
    record timestamp, pushed into the parquet scan."""
    lo = F.lit(start).cast("timestamp")
    hi = lo + F.make_dt_interval(secs=F.lit(duration_seconds))
    raw = spark.read.parquet(path)
    return raw.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
