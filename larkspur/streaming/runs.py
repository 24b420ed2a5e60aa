"""Streams worked off to the end, with their results as tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.streaming.counters import event_stream, run_available, to_table, windowed_spend
from larkspur.streaming.keyed import fan_out, first_breach_alerts, first_hit_limits, keyed_state


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's checkpoint folder; one of this machine only where that is unset and Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-", dir=os.environ.get("TMPDIR"))
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Daily spend of the event files, worked off as a stream."""
    base = shared_folder(spark)
    run_available(windowed_spend(event_stream(spark, folder)), to_table(f"{base}/out"), f"{base}/state")
    return spark.read.schema("day string, category string, n bigint, spent double").parquet(f"{base}/out").select("day", "category", "n", "spent")


def stream_limits(spark: SparkSession, folder: str, limits: dict[str, int], default: int, seconds: int) -> DataFrame:
    """Decisions on the event files as requests of users to routes (event types), worked off as a stream."""
    base = shared_folder(spark)
    with keyed_state(spark):
        run_available(first_hit_limits(event_stream(spark, folder), "user_id", "event_type", "ts", "event_id", limits, default, seconds), to_table(f"{base}/out"), f"{base}/state")
    return spark.read.schema("tracker string, route string, id string, index bigint, allowed boolean, retry_after bigint").parquet(f"{base}/out").drop("batch")


def stream_alerts(spark: SparkSession, folder: str, caps: dict[str, float], chat_ids: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Messages on the event files' spend by category (event type), one per breached day and chat, worked off as a stream."""
    base = shared_folder(spark)
    with keyed_state(spark):
        run_available(first_breach_alerts(event_stream(spark, folder), "event_type", "ts", "value", "event_id", caps), fan_out(f"{base}/out", chat_ids, labels), f"{base}/state")
    return spark.read.schema("category string, day string, chat_id string, text string").parquet(f"{base}/out").select("category", "day", "chat_id", "text")
