import os

import pytest
from pyspark.sql import functions as F

from retainly.streaming import compacted as CS

SCHEMA = "k bigint, v bigint"


def batch(spark, n):
    return spark.range(3).select(((F.col("id") * 7 + n) % 20).alias("k"), F.lit(n).cast("bigint").alias("v")).coalesce(1)


def want(upto):
    rows = {}
    for n in range(upto):
        for i in range(3):
            rows[(i * 7 + n) % 20] = n
    return rows


def got(spark, path):
    return {r.k: r.v for r in CS.current(spark, path, ["k"], SCHEMA).collect()}


def test_many_batches_leave_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert got(spark, path) == {}
    run, most = CS.compacting_sink(path, ["k"], fan=3), 0
    for n in range(45):
        run(batch(spark, n), n)
        most = max(most, len(os.listdir(f"{path}/data")))
    assert got(spark, path) == want(45)
    assert most <= 2 * 3 * 4 and len([m for m in os.listdir(f"{path}/manifests") if m.endswith(".json") and m.startswith("v")]) == CS.KEEP


def test_replays_and_crashes_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    run = CS.compacting_sink(path, ["k"], fan=2)
    for n in range(3):
        run(batch(spark, n), n)
    run(batch(spark, 99), 2)  # a batch that is in the table already
    assert got(spark, path) == want(3)
    whole = CS._Store.commit
    monkeypatch.setattr(CS._Store, "commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(batch(spark, 3), 3)  # written, not switched to
    assert got(spark, path) == want(3)
    monkeypatch.setattr(CS._Store, "commit", whole)
    run(batch(spark, 3), 3)
    assert got(spark, path) == want(4)
    live = {f["name"] for v in CS._Store(spark, path).versions() for f in CS._Store(spark, path).read(v)["folders"]}
    assert set(os.listdir(f"{path}/data")) == live  # what the crash left is gone


def test_a_version_is_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    CS.compacting_sink(path, ["k"])(batch(spark, 0), 0)
    store = CS._Store(spark, path)
    with pytest.raises(RuntimeError):
        store.commit(store.current())
