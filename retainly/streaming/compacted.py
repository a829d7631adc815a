"""A compacting sink for update-mode streams.

Every micro-batch is a folder of rows with its batch id. A manifest lists the
folders that make up the table and the last batch in it; a version of the table
is its manifest, put in place by one rename, so readers see a batch whole or not
at all. When FAN folders of a level have come together they are merged, latest
row by key, into one of the next level: a table of B batches has at most FAN
times log(B) folders, and a row is rewritten as often as there are levels.

A batch that is replayed after it was committed is left out; one that was cut
short left a folder that no manifest names, which the next commit deletes.
Folders of the KEEP last versions stay, for readers that began with them. One
writer a table, as a streaming query is; a rename onto a version that another
writer made fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
KEEP = 2
BATCH = "_batch"


class _Store:
    """Manifests and folders of a table, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[str]:
        return [n for n in self.names("manifests") if n.startswith("v") and n.endswith(".json")]

    def read(self, version: str) -> dict:
        stream = self.fs.open(self._at(f"manifests/{version}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> dict:
        versions = self.versions()
        return self.read(versions[-1]) if versions else {"version": 0, "last": -1, "folders": []}

    def commit(self, manifest: dict) -> None:
        name, half = f"v{manifest['version']:012d}.json", f"half-{uuid.uuid4().hex}"
        out = self.fs.create(self._at(f"manifests/{half}"), False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self.fs.exists(self._at(f"manifests/{name}")) or not self.fs.rename(self._at(f"manifests/{half}"), self._at(f"manifests/{name}")):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was made by another writer")

    def tidy(self) -> None:
        """Delete versions before the last KEEP, and what no version names."""
        versions = self.versions()
        for name in self.names("manifests"):
            if name not in versions[-KEEP:]:
                self.fs.delete(self._at(f"manifests/{name}"), False)
        live = {f["name"] for v in versions[-KEEP:] for f in self.read(v)["folders"]}
        for name in self.names("data"):
            if name not in live:
                self.fs.delete(self._at(f"data/{name}"), True)


def _latest(df: DataFrame, keys) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_v"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def compacting_sink(path: str, keys, fan: int = FAN):
    """A `foreachBatch` function: rows replace those of earlier batches that have the same `keys`."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _Store(spark, path)
        now = store.current()
        if batch_id <= now["last"]:
            return  # committed before a restart
        folders = now["folders"]

        def put(rows: DataFrame, level: int) -> dict:
            name = f"{level}-{batch_id}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(f"{store.path}/data/{name}")
            return {"name": name, "level": level}

        folders = [*folders, put(batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")), 0)]
        level = 0
        while len(own := [f for f in folders if f["level"] == level]) >= fan:
            rows = spark.read.parquet(*[f"{store.path}/data/{f['name']}" for f in own])
            folders = [f for f in folders if f["level"] != level] + [put(_latest(rows, keys), level + 1)]
            level += 1
        store.commit({"version": now["version"] + 1, "last": batch_id, "folders": folders})
        store.tidy()
    return run


def current(spark: SparkSession, path: str, keys, schema) -> DataFrame:
    """The table as last committed: the latest row of each key. `schema`: of the rows, for a table without batches."""
    store = _Store(spark, path)
    folders = store.current()["folders"]
    if not folders:
        return spark.createDataFrame([], schema)
    return _latest(spark.read.parquet(*[f"{store.path}/data/{f['name']}" for f in folders]), list(keys)).drop(BATCH)
