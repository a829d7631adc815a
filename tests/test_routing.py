import pytest
from pyspark.sql import functions as F

from retainly.streaming import routing as R

SCHEMAS = {"orders.eu": "id bigint, amount double", "clicks": "id bigint, page struct<url: string>"}
RECORDS = [
    ("orders.eu", '{"id": 1, "amount": 2.5}', "orders.eu", None), ("orders.eu", '{"id": 2}', "orders.eu", None), ("orders.eu", '{"id": "x", "amount": 1}', R.REJECTS, "undecodable"),
    ("orders.eu", '{"amount": 1}', R.REJECTS, "missing id"), ("orders.eu", "{", R.REJECTS, "undecodable"), ("orders.eu", None, R.REJECTS, "no value"), ("orders.eu", "", R.REJECTS, "undecodable"),
    ("clicks", '{"id": 3, "page": {"url": "u"}, "more": 1}', "clicks", None), ("clicks", '{"id": 3, "page": 7}', R.REJECTS, "undecodable"), ("other", '{"id": 1}', R.REJECTS, "unknown topic"),
    (None, '{"id": 1}', R.REJECTS, "unknown topic"),
]


def records(spark):
    return spark.createDataFrame([(t, v) for t, v, *_ in RECORDS], "topic string, v string").select("topic", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.col("v").cast("binary").alias("value"))


def test_each_record_is_in_one_table(spark):
    got = R.route(records(spark), SCHEMAS, {"orders.eu": ["id"]}).collect()
    assert [(r.topic, r.table, r.error) for r in got] == [(t, table, e) for t, _, table, e in RECORDS]
    assert [None if r.value is None else bytes(r.value).decode() for r in got] == [v if e else None for _, v, _, e in RECORDS]
    with pytest.raises(ValueError):
        R.route(records(spark), {"a.b": "id int", "a_b": "id int"})


def test_a_stream_lands_in_tables(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    records(spark).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(records(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = R.land(R.route(stream, SCHEMAS, {"orders.eu": ["id"]}), out, str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 2  # as the source's option says
    assert sorted((r.id, r.amount) for r in R.read_topic(spark, out, "orders.eu").collect()) == [(1, 2.5), (2, None)]
    assert [(r.id, r.page.url) for r in R.read_topic(spark, out, "clicks").collect()] == [(3, "u")]
    assert R.read_rejects(spark, out).count() == 8
    assert "PartitionFilters: [isnotnull(table" in R.read_topic(spark, out, "clicks")._jdf.queryExecution().executedPlan().toString()
