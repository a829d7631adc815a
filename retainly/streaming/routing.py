"""Routed landing of several topics (S3, S14): one pass, a table for each topic and one of rejects.

Each record is decoded by its topic's schema. What decodes and has its required
fields goes to the topic's table; everything else goes to the reject table with
its bytes and the reason, so every record is in exactly one. All tables lie in
one folder, partitioned by `table`: one exactly-once file sink writes them in one
pass, and a reader of a table opens only its files. The decoded fields are a
struct a topic; those of other topics are null and take no room in Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REJECTS = "_rejects"
_BAD = "_undecodable"


def _column(topic: str) -> str:
    return "m_" + re.sub(r"\W", "_", topic)


def route(records: DataFrame, schemas: dict[str, str], required: dict[str, list[str]] | None = None) -> DataFrame:
    """records (topic, timestamp, value bytes) -> table, topic, timestamp, value and error (of rejects), and a struct for each topic of
    `schemas` (a DDL text each). `required`: fields of a topic that must not be null."""
    names = {t: _column(t) for t in schemas}
    if len(set(names.values())) < len(names):
        raise ValueError("topics whose names differ only in signs share a column")
    text = F.col("value").cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    df = records.select("topic", "timestamp", "value", *[
        F.when(F.col("topic") == t, F.from_json(text, f"{ddl}, {_BAD} string", options)).alias(names[t]) for t, ddl in schemas.items()])
    error = F.when(F.col("topic").isNull() | ~F.col("topic").isin(list(schemas)), "unknown topic").when(F.col("value").isNull(), "no value")
    for t, c in names.items():
        own = F.col("topic") == t
        error = error.when(own & (F.col(c).isNull() | F.col(f"{c}.{_BAD}").isNotNull()), "undecodable")
        for field in (required or {}).get(t, []):
            error = error.when(own & F.col(f"{c}.{field}").isNull(), f"missing {field}")
    df = df.withColumn("error", error)
    good = F.col("error").isNull()
    return df.select(F.when(good, F.col("topic")).otherwise(REJECTS).alias("table"), "topic", "timestamp", F.when(~good, F.col("value")).alias("value"), "error",
                     *[F.when(good, F.col(c).dropFields(_BAD)).alias(c) for c in names.values()])


def land(routed: DataFrame, path: str, checkpoint: str):
    """Write a routed stream to its tables until its backlog is through. How much a micro-batch takes is an option of the source
    (`maxOffsetsPerTrigger`, `maxFilesPerTrigger`)."""
    return (routed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("table")
            .outputMode("append").trigger(availableNow=True).start())


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """A topic's table: timestamp and its fields."""
    return spark.read.parquet(path).where(F.col("table") == topic).select("timestamp", f"{_column(topic)}.*")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """topic, timestamp, value, error of the records that are in no topic's table."""
    return spark.read.parquet(path).where(F.col("table") == REJECTS).select("topic", "timestamp", "value", "error")
