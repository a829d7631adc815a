"""Session construction and shared-storage helpers.

Cluster settings (shuffle partitions, checkpoint directory, broadcast
threshold) are read from the running session; defaults are filled in only
where a setting is unset, as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. They are semantic (time zone) or protect the
# plan shape at scale (AQE coalescing / skew splitting); none is a tuning
# guess that should override a cluster's own value when already set.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "retainly",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests, benches and examples (UI off, UTC)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Fill in the semantic defaults on an existing session, never overriding."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when the setting is absent (local tests) a private folder is created
    and registered, so `DataFrame.checkpoint()` and scratch tables work.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines cannot read a driver-local folder
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
        # A running session's settings can't be changed; the context keeps the folder (one of its own in it).
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="retainly-ckpt-"))
        return spark.sparkContext.getCheckpointDir()
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}") if "://" not in base \
        else f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (for inputs read many times: model training, several ordered passes).
    Survives executor loss: the data is re-read from shared storage, not
    recomputed from the sources."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
