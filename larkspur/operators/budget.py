"""Spend by day, budgets, rate limits and alerts, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.cost import money, utc_day


def daily_spend(events: DataFrame, category: str, ts: str, amount: str) -> DataFrame:
    return events.groupBy(F.col(category).alias("category"), utc_day(F.col(ts)).alias("day")).agg(F.sum(money(F.col(amount))).cast("double").alias("spent"))


#: A number at the start of a text.
_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def spent_number(spent: Column) -> Column:
    """The number that a counter's text begins with, 0 if there is none: 5abc is 5, Infinity is that, and NaN and null are 0."""
    return F.coalesce(F.nullif(F.regexp_extract(spent, _NUMBER, 1), F.lit("")).try_cast("double"), F.lit(0.0))


def blocked(spent: Column, cap: float) -> Column:
    """Spent at or over the cap; a counter that is no number allows, as none does."""
    return spent_number(spent) >= cap


def running_spend(events: DataFrame, category: str, ts: str, amount: str, key: str) -> DataFrame:
    """events with what was spent before each on its day. A day of a category is one ordered run by its nature."""
    run = Window.partitionBy(category, utc_day(F.col(ts))).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("spent_before", F.coalesce(F.sum(money(F.col(amount))).over(run), F.lit(0)).cast("double"))


def first_breaches(events: DataFrame, category: str, ts: str, amount: str, key: str, cap: float, bucket: str = "minute") -> DataFrame:
    """(category, day, key, at): of each day the first event that comes with the cap already spent.

    Amounts are summed by bucket first, and a day's few buckets get what was spent before each. Only events of buckets in
    which the cap may be reached are put in order, up to the first bucket that begins with the cap spent; so no task sorts a whole day.
    """
    money_, place = money(F.col(amount)), F.struct(F.col(ts).alias("at"), F.col(key).alias("key"))
    named = events.select(F.col(category).alias("category"), utc_day(F.col(ts)).alias("day"), F.date_trunc(bucket, F.col(ts)).alias("bucket"), place.alias("place"), money_.alias("amount"))
    sums = named.groupBy("category", "day", "bucket").agg(F.sum("amount").alias("spent"), F.sum(F.greatest("amount", F.lit(0).cast("decimal(18,8)"))).alias("gained"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("spent").over(Window.partitionBy("category", "day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("before", before)
    over = placed.filter(F.col("before") >= cap).groupBy("category", "day").agg(F.min("bucket").alias("over"), F.min("first").alias("place"))
    inside = placed.filter((F.col("before") < cap) & (F.col("before") + F.coalesce("gained", F.lit(0)) >= cap)).join(over.select("category", "day", "over"), ["category", "day"], "left")
    inside = inside.filter(F.col("over").isNull() | (F.col("bucket") < F.col("over"))).select("category", "day", "bucket", "before")
    own = Window.partitionBy("category", "day", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    reached = named.join(inside, ["category", "day", "bucket"]).withColumn("so_far", F.col("before") + F.coalesce(F.sum("amount").over(own), F.lit(0))).filter(F.col("so_far") >= cap)
    found = reached.select("category", "day", "place").unionByName(over.select("category", "day", "place")).groupBy("category", "day").agg(F.min("place").alias("place"))
    return found.select("category", "day", F.col("place.key").alias(key), F.col("place.at").alias("at"))


def alert_text(category: Column, spent: Column, cap: Column, day: Column, labels: dict[str, str] | None = None) -> Column:
    """What an alert says: the category by its label, what was spent (to four places), the cap, by how much it is over, and when the counter starts again."""
    pairs = [F.lit(x) for p in (labels or {}).items() for x in p]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), category), category) if pairs else category
    number = lambda c: F.regexp_replace(c.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")
    over = F.floor((spent - cap) / cap * 100 + 0.5).cast("string")
    resets = F.date_format(F.date_add(F.to_date(day, "yyyyMMdd"), 1), "yyyy-MM-dd")
    return F.concat(
        F.lit("<b>Budget exceeded</b>\n\n<b>Category:</b> "), label, F.lit("\n<b>Spent:</b> $"), number(F.floor(spent * 10000 + 0.5) / 10000), F.lit(" (cap $"), number(cap), F.lit(", +"), over, F.lit("%)\n<b>Resets:</b> "),
        resets, F.lit("T00:00:00.000Z"),
    )


def first_hit(events: DataFrame, tracker: str, ts: str, key: str, limit: int, seconds: int) -> DataFrame:
    """events with index, allowed and opened: a window opens at a tracker's first request outside of one and is over after some seconds.

    A tracker's requests are gone through in order of ts and key as a sorted stream, with one window held at a time.
    """
    names = events.columns
    at = "_at"
    rows = events.withColumn(at, F.unix_micros(F.col(ts).cast("timestamp"))).filter(F.col(at).isNotNull()).repartition(tracker).sortWithinPartitions(tracker, at, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", index bigint, allowed boolean, opened bigint"
    width, own, place = seconds * 1_000_000, names.index(tracker), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, hits = object(), 0, 0
        for batch in batches:
            index, starts = [], []
            for who, when in zip(batch.column(own).to_pylist(), batch.column(place).to_pylist()):
                if who != last or when >= opened + width:
                    last, opened, hits = who, when, 0
                hits += 1
                index.append(hits)
                starts.append(opened)
            added = [pa.array(index, pa.int64()), pa.array([n <= limit for n in index], pa.bool_()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *added], names=[*names, "index", "allowed", "opened"])

    return rows.mapInArrow(run, schema)


def throttled(events: DataFrame, tracker: str, ts: str, key: str, limit: int, width: str = "minute") -> DataFrame:
    """events with their index in their tracker's window of a minute, and whether they are let through."""
    own = Window.partitionBy(tracker, F.date_trunc(width, F.col(ts))).orderBy(ts, key)
    return events.withColumn("index", F.row_number().over(own)).withColumn("allowed", F.col("index") <= limit)


def latest_status(events: DataFrame, service: str, ts: str, status: Column) -> DataFrame:
    return events.groupBy(F.col(service).alias("service")).agg(F.max_by(status, F.struct(ts, "event_id")).alias("status"), F.max(ts).alias("at"))
