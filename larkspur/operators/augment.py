"""Augmentation: set hashes, cache hits, and the cap on model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_hash(digests: Column) -> Column:
    """One digest of a set of digests, whatever their order; of none, the digest of the empty text."""
    return F.sha2(F.array_join(F.sort_array(F.coalesce(digests, F.array().cast("array<string>"))), ":"), 256)


def bucketed_hash(rows: DataFrame, key: str, digest: str, digits: int = 3) -> DataFrame:
    """(key, set_hash): the digest of each key's digests, which are gathered by their first hexadecimal digits and then bucket by bucket,
    so that a key of very many rows is never one list.
    """
    buckets = rows.groupBy(key, F.substring(digest, 1, digits).alias("_bucket")).agg(set_hash(F.collect_list(digest)).alias("_h"))
    return buckets.groupBy(key).agg(set_hash(F.collect_list("_h")).alias("set_hash"))


def cached(items: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """items with hit and the cached description; a hit needs the same images and the same model."""
    # one row per key: that of the wanted model and images, if there are several
    one = cache.groupBy(key).agg(F.collect_set(F.struct(F.col("image_hash").alias("h"), F.col("model_version").alias("m"), F.col("visual_description").alias("d"))).alias("_rows"))
    own = F.get(F.array_sort(F.filter("_rows", lambda r: (r["h"] == F.col("image_hash")) & (r["m"] == version))), F.lit(0))
    joined = items.join(one, key, "left").withColumn("_own", own)
    joined = joined.withColumns({"_hash": F.col("_own.h"), "visual_description": F.col("_own.d"), "model_version": F.col("_own.m")}).drop("_rows", "_own")
    hit = F.coalesce((F.col("image_hash") == F.col("_hash")) & (F.col("model_version") == version), F.lit(False))
    return joined.withColumn("hit", hit).withColumn("visual_description", F.when(hit, F.col("visual_description"))).drop("_hash", "model_version")


def capped(items: DataFrame, miss: Column, order: str, cap: int, key: str | None = None) -> DataFrame:
    """items with call: a miss that is among the first cap misses, in order, with ties by key (which names a row; order itself, if it does).

    The cap is a number of rows, so the last row that may call is found by a top-k, and all others are compared with it.
    """
    place = F.struct(order, key) if key else F.struct(order)
    edge = items.filter(miss).select(place.alias("_edge")).orderBy("_edge").limit(cap).agg(F.max("_edge").alias("_edge"))  # a top-k, in bounded heaps
    return items.crossJoin(F.broadcast(edge)).withColumn("call", miss & F.coalesce(place <= F.col("_edge"), F.lit(False))).drop("_edge")
