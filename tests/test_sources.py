"""Option builders of the database and Kafka readers (S1-S4, S14). No
database or broker exists here, so the readers' options are checked, not
their connections."""

import pytest

from retainly.sources.io import jdbc_options, kafka_options


def test_jdbc_query_read_uses_one_connection():
    o = jdbc_options("jdbc:postgresql://db/x", query="SELECT 1", user="u", password="p")
    assert o["query"] == "SELECT 1" and "dbtable" not in o and "partitionColumn" not in o
    assert o["user"] == "u" and o["password"] == "p" and o["fetchsize"] == "10000"


def test_jdbc_partitioned_table_read():
    o = jdbc_options("jdbc:mysql://db/x", table="customers", partition_column="customer_id",
                     lower=1, upper=5_000_000, num_partitions=200)
    assert (o["dbtable"], o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == \
        ("customers", "customer_id", "1", "5000000", "200")


@pytest.mark.parametrize("kw", [dict(), dict(query="q", table="t"),
                                dict(query="q", partition_column="id", lower=0, upper=9, num_partitions=2),
                                dict(table="t", partition_column="id")])
def test_jdbc_rejects_ambiguous_or_incomplete_options(kw):
    with pytest.raises(ValueError):
        jdbc_options("jdbc:postgresql://db/x", **kw)


def test_kafka_stream_and_time_bounded_batch_options():
    s = kafka_options("b1:9092,b2:9092", ["customer_events", "transactions"], max_offsets_per_trigger=1000)
    assert s["subscribe"] == "customer_events,transactions"
    assert s["maxOffsetsPerTrigger"] == "1000" and s["startingOffsets"] == "latest"
    b = kafka_options("b1:9092", "customer_events", start_ts=1_700_000_000_000, end_ts=1_700_000_060_000)
    assert b["startingTimestamp"] == "1700000000000" and b["endingTimestamp"] == "1700000060000"
    assert "startingOffsets" not in b
