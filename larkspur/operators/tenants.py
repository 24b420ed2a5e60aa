"""Vectors stored by tenant, so that a search for one reads its folder and no other.

A tenant of more than ``rows`` vectors is written in pieces, by as many tasks, and its files are read by as many; small tenants have one file each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import search

#: Rows of a piece.
ROWS = 100_000


def write(vectors: DataFrame, path: str, tenant: str = "tenant", key: str = "vec_id", rows: int = ROWS) -> None:
    """vectors to path, a folder for each tenant; rows without one go to a folder of their own."""
    counts = vectors.groupBy(F.col(tenant).alias("_tenant")).agg(F.count(F.lit(1)).alias("_n"))
    # only hot tenants have more than one piece; they are at most as many as rows fit in
    hot = counts.filter(F.col("_n") > rows).select("_tenant", F.ceil(F.col("_n") / rows).alias("_pieces"))
    dealt = vectors.join(hot, vectors[tenant].eqNullSafe(hot["_tenant"]), "left").withColumn("_piece", F.pmod(F.xxhash64(key), F.coalesce("_pieces", F.lit(1))))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt.repartition(parts, tenant, "_piece").drop("_tenant", "_pieces", "_piece").write.mode("overwrite").partitionBy(tenant).parquet(path)


def read(spark: SparkSession, path: str, tenant: str, value: str | int) -> DataFrame:
    """The vectors of one tenant; the filter is on the folder."""
    return spark.read.parquet(path).filter(F.col(tenant) == F.lit(value))


def top_k(spark: SparkSession, path: str, tenant: str, value: str | int, query: Sequence[float] | DataFrame, k: int, where: Column | None = None, **options) -> DataFrame:
    return search.top_k(read(spark, path, tenant, value), query, k, where=where, **options)
