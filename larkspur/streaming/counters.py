"""Counters, rate limits and alerts as Structured Streaming, with watermarks.

Timestamps without zone are cast, as watermarks need an instant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The folder's event files as a stream; the schema is taken from the files there are."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_spend(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """(day, category, n, spent) of closed windows."""
    w = F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,8)")).alias("spent"))
    return sums.select(F.date_format("window.start", "yyyyMMdd").alias("day"), "category", "n", F.col("spent").cast("double").alias("spent"))


def request_counts(events: DataFrame, tracker: str = "user_id", width: str = "1 minute", late: str = LATE) -> DataFrame:
    """(tracker, window start, n) of closed windows, for limits on requests."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, F.col(tracker).alias("tracker")).agg(F.count(F.lit(1)).alias("n")).select("tracker", F.col("window.start").alias("start"), "n")


def alerts_once(breaches: DataFrame, keep: str = "25 hours") -> DataFrame:
    """The first breach of each category and day; later ones within the watermark are dropped."""
    return breaches.withColumn("day", F.date_format("ts", "yyyyMMdd")).withWatermark("ts", keep).dropDuplicatesWithinWatermark(["category", "day"])


def distinct_inputs(events: DataFrame, digest: str, late: str = LATE) -> DataFrame:
    """Repeated inputs go through once, so that a retried one costs nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([digest])


def run_available(stream: DataFrame, target: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there, in batches, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(target).start()
    query.awaitTermination()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A target that writes each batch to its own folder, so that a repeated batch replaces itself."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
