"""Decisions that need what came before: limits by windows that a first request opens, and alerts when a budget is spent.

Both keep state by key, with timers in event time. Rows wait in the state until the watermark has passed them and are then taken in order of time and id, so the
results are those of going through all rows in that order, however they were cut into batches and also after a restart. Rows that come later than
the watermark allows are dropped by Spark. What waits is bounded by the time that rows may be late.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.functions.cost import money, utc_day
from larkspur.operators.budget import alert_text

#: The store that state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session's setting of the state store, while streams of this module are started and run."""
    key, value = PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class InOrder(StatefulProcessor):
    """Holds rows (JSON: at in microseconds, id, value) until the watermark has passed them, and gives them to step() in order.

    Each value of the state and each key costs messages, which is what the time goes to; so a key's rows of one batch are one value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "batch string")
        self.seen = handle.getValueState("seen", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = "[" + ",".join(r["row"] for r in rows) + "]"
        self.waiting.appendValue((batch,))
        self.wake(min(int(at) for at, _, _ in json.loads(batch)))
        return iter(())

    def wake(self, at: int) -> None:
        """A timer for when the watermark has passed at. An equal one is not set twice."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(at), id_, value) for (batch,) in self.waiting.get() for at, id_, value in json.loads(batch))
        due = [h for h in held if h[0] < passed]
        later = held[len(due) :]
        if later:
            self.waiting.put([(json.dumps(later),)])
            self.wake(later[0][0])
        elif held:
            self.waiting.clear()
        before = self.seen.get()
        before = before if before is None else tuple(before)
        state, out = self.load(before), []
        for at, id_, value in due:
            state, row = self.step(key, state, at, id_, value)
            if row is not None:
                out.append(row)
        after = self.store(state, None if later else passed)
        if after is None:
            # state goes when its time is over
            if before is not None:
                self.seen.clear()
        else:
            if after != before:
                self.seen.update(after)
            self.handle.registerTimer(self.end(state) // 1000 + 1)
        return iter(out)

    def load(self, stored: tuple | None):
        return stored

    def store(self, state, passed: int | None) -> tuple | None:
        """What to keep of a state; nothing, if its time is over at the watermark passed (null: rows wait for it)."""
        return None if state is None or passed is not None and self.end(state) < passed else state

    def close(self) -> None:
        pass


class FirstHit(InOrder):
    """A window opens at a request outside of one; the requests in it are counted, and those beyond the limit are not let through.

    A key is a tracker; its windows are those of its routes. A row's value is the limit, a colon and the route.
    """

    fields = "windows string"

    def __init__(self, width: int):
        self.width = width  # microseconds

    def load(self, stored):
        return json.loads(stored[0]) if stored else {}

    def step(self, key, state, at, id_, value):
        limit, _, route = value.partition(":")
        opened, hits = state.get(route, (at, 0))
        if at >= opened + self.width:
            opened, hits = at, 0
        state[route] = opened, hits + 1
        allowed = hits + 1 <= int(limit)
        return state, Row(tracker=key[0], route=route, id=id_, index=hits + 1, allowed=allowed, retry_after=None if allowed else -((at - opened - self.width) // 1_000_000))

    def store(self, state, passed):
        own = {r: w for r, w in state.items() if passed is None or w[0] + self.width >= passed}
        return (json.dumps(own),) if own else None

    def end(self, state) -> int:
        return max(opened for opened, _ in state.values()) + self.width


class FirstBreach(InOrder):
    """Adds up a day's amounts; the first row that comes with the cap already spent is an alert, and no other of that day."""

    fields = "spent string, alerted boolean, day_end bigint"

    def __init__(self, caps: dict[str, str]):
        self.caps = caps

    def step(self, key, state, at, id_, value):
        spent, alerted, end = state or ("0", False, (at // 86_400_000_000 + 1) * 86_400_000_000)
        cap, row = self.caps.get(key[0]), None
        if cap is not None and not alerted and Decimal(spent) >= Decimal(cap):
            alerted, row = True, Row(category=key[0], day=key[1], id=id_, at=at, spent=float(spent), cap=float(cap))
        return (str(Decimal(spent) + Decimal(value or "0")), alerted, end), row

    def end(self, state) -> int:
        return state[2]


def _ordered(events: DataFrame, keys: list, ts: str, key: str, value, late: str) -> DataFrame:
    own = events.withWatermark(ts, late).select(*keys, F.col(ts).alias("ts"), F.to_json(F.array(F.unix_micros(ts).cast("string"), F.col(key).cast("string"), value.cast("string"))).alias("row"), F.col(key).isNotNull().alias("known"))
    return own.filter("ts is not null and known").drop("known")


def first_hit_limits(events: DataFrame, tracker: str, route: str, ts: str, key: str, limits: dict[str, int], default: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(tracker, route, id, index, allowed, retry_after) of requests: each tracker has a window of its own on each route."""
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in limits.items() for x in p)), F.col(route)), F.lit(default)) if limits else F.lit(default)
    who, where = F.coalesce(F.col(tracker).cast("string"), F.lit("unknown")), F.coalesce(F.col(route), F.lit(""))
    # one key for all routes of a tracker, but for the unknown ones, who may be very many
    rows = _ordered(events, [who.alias("tracker"), F.when(who == "unknown", where).otherwise("").alias("of")], ts, key, F.concat(limit.cast("string"), F.lit(":"), where), late)
    out = "tracker string, route string, id string, index bigint, allowed boolean, retry_after bigint"
    return rows.groupBy("tracker", "of").transformWithState(FirstHit(seconds * 1_000_000), out, "Append", "EventTime")


def first_breach_alerts(events: DataFrame, category: str, ts: str, amount: str, key: str, caps: dict[str, float], late: str = "1 hour") -> DataFrame:
    """(category, day, id, at, spent, cap): of each category with a cap and each UTC day the first row that comes with the cap spent; at in microseconds."""
    rows = _ordered(events.filter(F.col(category).isNotNull()), [F.col(category).alias("category"), utc_day(F.col(ts)).alias("day")], ts, key, money(F.col(amount)), late)
    out = "category string, day string, id string, at bigint, spent double, cap double"
    return rows.groupBy("category", "day").transformWithState(FirstBreach({c: str(v) for c, v in caps.items()}), out, "Append", "EventTime")


def fan_out(path: str, chat_ids: Sequence[str], labels: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A target that writes a message per alert and chat; a batch that is repeated after a failure replaces what it wrote."""

    def write(alerts: DataFrame, batch: int) -> None:
        chats = F.explode(F.array(*(F.lit(c) for c in chat_ids))).alias("chat_id") if chat_ids else F.explode(F.array().cast("array<string>")).alias("chat_id")
        text = alert_text(F.col("category"), F.col("spent"), F.col("cap"), F.col("day"), labels)
        alerts.select("category", "day", chats, text.alias("text")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
