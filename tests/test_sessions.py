import random
from datetime import datetime, timedelta

from retainly.streaming import jobs as J

SCHEMA = "customer_id bigint, event_type string, event_timestamp timestamp"


def rows(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(8), rng.choice(["page_view", "purchase"]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(3 * 86400))) for _ in range(n)]


def plain(rows):
    out = []
    for c in {r[0] for r in rows}:
        session = []
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[2]):
            if session and r[2] - session[-1][2] > timedelta(minutes=30):
                out.append(session)
                session = []
            session.append(r)
        out.append(session)
    return sorted((s[0][0], s[0][2], (s[-1][2] - s[0][2]).total_seconds(), sum(r[1] == "page_view" for r in s), len(s)) for s in out)


def landed(spark, src, tmp, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = J.customer_sessions(stream).writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("customer_id bigint, session_start timestamp, duration_seconds double, page_views bigint, events bigint").parquet(f"{tmp}/{name}").where("customer_id is not null").collect()), q


def test_stream_equals_the_batch_twin_in_any_order(spark, tmp_path):
    data = rows()
    assert sorted(tuple(r) for r in J.customer_sessions(spark.createDataFrame(data, SCHEMA)).collect()) == plain(data)
    for k in (1, 2):
        random.Random(k).shuffle(data)
        src = str(tmp_path / f"src{k}")
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(src)  # a watermark only drops what comes after its batch
        spark.createDataFrame([(None, None, datetime(2024, 1, 9))], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got, q = landed(spark, src, tmp_path, f"out{k}")
        assert got == plain(data) and J.late_events(q) == 0


def test_late_events_are_counted(spark, tmp_path):
    src = str(tmp_path / "src")
    for part in ([(1, "page_view", datetime(2024, 1, 1))], [(None, None, datetime(2024, 1, 9))], [(1, "page_view", datetime(2024, 1, 1, 0, 5)), (2, "page_view", datetime(2024, 1, 2))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got, q = landed(spark, src, tmp_path, "out")
    assert got == [(1, datetime(2024, 1, 1), 0.0, 1, 1)] and J.late_events(q) == 2
