"""Helpers shared by the training-data operators.

Document identity. A document is a row (doc_id, text). Several operators need
an order and a key that also hold for repeated or null doc_ids; they use
(doc_id, text_key) with text_key = xxhash64(text): rows that agree in both are
one document, and each of them gets that document's result.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ensure_defaults, scratch_path

#: ASCII white space that separates words, as in `[^\x20\x09-\x0D]+` (also what bytes.split() uses).
SPACES = b" \t\n\x0b\x0c\r"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Session defaults, shared checkpoint folder, this package on the Python workers' path,
    and Arrow batches of few rows, as one row may be a very long text."""
    ensure_defaults(spark)
    checkpoint_dir(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *(p for p in paths if p)])
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def body(col: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_key(col: str = "text") -> Column:
    """64-bit key that separates documents of one doc_id (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read back:
    cuts the lineage, is columnar and compressed, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
