"""Driver tables: one parquet file per table under a scale-factor folder.

Reads are lazy; Catalyst prunes columns and pushes filters into each scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


@dataclass
class Tables:
    """Lazy accessor: `t.orders` reads `<root>/orders.parquet` once per accessor."""

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
