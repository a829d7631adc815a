"""Incremental feature state (F11, C9, C10, C19, F17): partial aggregates by customer and day.

A day's transactions and events become one row a customer: sums, counts, and
bitmaps of payment methods and sessions. The state is stored by day; a delta or a
correction rewrites its own days and no others. Features as of any midnight
merge the rows of the days that their windows reach back to, so an hourly or
daily refresh reads what changed and the state, never the history of orders.

Distinct counts come from bitmaps: distinct order days are rows, methods are a
bit each in a list that the caller fixes, sessions are bits by number in buckets,
so that a merge is a bitwise or.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = (7, 30, 90)


def transaction_days(transactions: DataFrame, methods) -> DataFrame:
    """transactions (customer_id, order_date, order_amount, payment_method) -> customer_id, day, amount, orders, methods: a bit for each of
    `methods` (63 at most), others count as the last. NULL customers and dates have no state."""
    methods = list(methods)
    if len(methods) > 63:
        raise ValueError("a state holds 63 payment methods")
    bit = F.coalesce(*[F.when(F.col("payment_method") == m, F.lit(1 << k)) for k, m in enumerate(methods)],
                     F.when(F.col("payment_method").isNotNull(), F.lit(1 << (len(methods) - 1)))).cast("bigint")
    rows = transactions.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
    return rows.groupBy("customer_id", F.to_date("order_date").alias("day")).agg(
        F.sum("order_amount").cast("decimal(28,2)").alias("amount"), F.count(F.lit(1)).alias("orders"), F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias("methods"))


def session_days(events: DataFrame, number: str) -> DataFrame:
    """events (customer_id, event_timestamp, a session number >= 0) -> customer_id, day, bucket, sessions: a bitmap of the numbers of a bucket
    of 32,768. One row a customer, day and bucket."""
    n = F.col(number).cast("bigint")
    rows = events.where(F.col("customer_id").isNotNull() & F.col("event_timestamp").isNotNull() & n.isNotNull())
    return rows.groupBy("customer_id", F.to_date("event_timestamp").alias("day"), F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("sessions"))


def store_days(state: DataFrame, path: str) -> None:
    """Write the days of `state`: days that are there are replaced as a whole, other days' files are not touched."""
    state.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def drop_days(spark: SparkSession, path: str, days) -> None:
    """Days (dates as text) whose rows are all gone."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for day in days:
        folder = fs_path(f"{path.rstrip('/')}/day={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_days(spark: SparkSession, path: str, as_of: str, back: int | None = None) -> DataFrame:
    """The state before the midnight `as_of`, and not older than `back` days: other days' files are not opened."""
    end = F.lit(as_of).cast("date")
    df = spark.read.parquet(path).where(F.col("day") < end)
    return df.where(F.col("day") >= F.date_sub(end, back)) if back else df


def window_features(state: DataFrame, as_of: str) -> DataFrame:
    """Rows of transaction_days() before the midnight `as_of` -> customer_id, purchase_value_<N>d and order_count_<N>d (F11), purchase_frequency_7d
    and _90d (C9, C10), payment_method_diversity over 90 days (C19). Customers without a day in the last 90 have no row."""
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    inside = {n: age.between(1, n) for n in WINDOWS}
    days = {n: F.count(F.when(inside[n], 1)) for n in WINDOWS}
    return state.where(inside[max(WINDOWS)]).groupBy("customer_id").agg(
        *[x for n in WINDOWS for x in (F.coalesce(F.sum(F.when(inside[n], F.col("amount"))), F.lit(0)).alias(f"purchase_value_{n}d"),
                                       F.coalesce(F.sum(F.when(inside[n], F.col("orders"))), F.lit(0)).alias(f"order_count_{n}d"))],
        (7.0 / F.greatest(F.lit(1), days[7])).alias("purchase_frequency_7d"), (90.0 / (days[90] + 1)).alias("purchase_frequency_90d"),
        F.bit_count(F.bit_or("methods")).cast("bigint").alias("payment_method_diversity"))


def session_counts(state: DataFrame) -> DataFrame:
    """Rows of session_days() -> customer_id, sessions: distinct session numbers over all days."""
    per = state.groupBy("customer_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("sessions")).alias("n"))
    return per.groupBy("customer_id").agg(F.sum("n").alias("sessions"))
