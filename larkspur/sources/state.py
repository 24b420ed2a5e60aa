"""Versioned state tables: a new version is written beside the old ones, then named as the current one.

A version is a folder of Parquet files; the current version is the highest one with Spark's success mark, so a run that
fails leaves the state as it was. Rows may expire by ``expires_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[0] == "v" and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1] if version is None else version}")

    def alive(self, now: Column) -> DataFrame:
        return self.read().filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))

    def write(self, rows: DataFrame) -> int:
        """Write rows as the next version, which may be computed from the current one."""
        version = (self.versions() or [0])[-1] + 1
        rows.select(*self.read().columns).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version
