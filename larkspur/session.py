"""A session with the settings that the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "larkspur", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the session's ``spark.checkpoint.dir`` and read back; a folder of this machine only where that is unset and Spark is local."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR")))
    return without_vast_estimate(df.checkpoint(eager=True))


def without_vast_estimate(df: DataFrame) -> DataFrame:
    """df, a checkpoint; as a table of unknown size where Spark estimates more bytes than a long holds.

    A checkpoint keeps the estimate of its plan, and a join's is the product of its sides'. In a loop that joins a table with itself
    the estimate's digits double every time, until the driver's memory and time go to multiplying them.
    """
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)
