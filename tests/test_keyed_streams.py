"""Limits and alerts as streams equal a plain replay, with rows out of order, in any batches and after a restart."""

import json
from datetime import datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import budget
from larkspur.streaming.counters import run_available, to_table
from larkspur.streaming.keyed import FirstHit, fan_out, first_breach_alerts, first_hit_limits, keyed_state

SCHEMA = "event_id bigint, ts timestamp, user string, route string, amount double"
START = datetime(2024, 1, 1)


def made(n, seed):
    rng = np.random.default_rng(seed)
    out, now = [], 0.0
    for i in range(n):
        now += float(rng.exponential(20))
        # rows are late by up to half a minute
        late = float(rng.integers(0, 30)) if rng.random() < 0.3 else 0.0
        out.append((i, START + timedelta(seconds=round(max(now - late, 0), 3)), str(rng.choice(["a", "b", "c"])), str(rng.choice(["search", "list"])), round(float(rng.random()), 2)))
    return out


def run_in_two(spark, folder, rows, make, target):
    """The rows as files, worked off in two runs of one checkpoint, each in batches of one file."""
    for part, own in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        for k in range(0, len(own), 60):
            spark.createDataFrame(own[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        with keyed_state(spark):
            run_available(make(stream), target, f"{folder}/state")


def watermark(rows):
    return max(r[1] for r in rows) - timedelta(minutes=1)


def test_limits_equal_a_replay(spark, tmp_path):
    rows = made(240, 1)
    out = to_table(str(tmp_path / "out"))
    run_in_two(spark, str(tmp_path), rows, lambda s: first_hit_limits(s, "user", "route", "ts", "event_id", {"search": 2}, 3, 60, "1 minute"), out)
    got = {r["id"]: (r["index"], r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, open_ = {}, {}
    for i, ts, user, route, _ in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        opened, hits = open_.get((user, route), (None, 0))
        if opened is None or ts >= opened + timedelta(seconds=60):
            opened, hits = ts, 0
        open_[user, route] = opened, hits + 1
        allowed = hits + 1 <= (2 if route == "search" else 3)
        left = (opened + timedelta(seconds=60) - ts).total_seconds()
        if ts < watermark(rows):
            want[str(i)] = (hits + 1, allowed, None if allowed else int(-(-left // 1)))
    assert got == want and not all(a for _, a, _ in want.values())


def test_alerts_equal_a_replay_and_the_batch_form(spark, tmp_path):
    rows = made(240, 2)
    caps, chats = {"search": 20.0}, ["1", "2"]
    run_in_two(spark, str(tmp_path), rows, lambda s: first_breach_alerts(s, "route", "ts", "amount", "event_id", caps, "1 minute"), fan_out(str(tmp_path / "out"), chats, {"search": "Search"}))
    got = sorted((r["category"], r["day"], r["chat_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    spent, breach = Decimal(0), None
    for i, ts, _, route, amount in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        if route == "search":
            if spent >= 20 and breach is None:
                breach = (i, spent)
            spent += Decimal(str(amount))
    over = int((float(breach[1]) - 20) / 20 * 100 + 0.5)
    text = f"<b>Budget exceeded</b>\n\n<b>Category:</b> Search\n<b>Spent:</b> ${breach[1].normalize():f} (cap $20, +{over}%)\n<b>Resets:</b> 2024-01-02T00:00:00.000Z"
    assert got == [("search", "20240101", c, text) for c in chats]
    batch = budget.first_breaches(spark.createDataFrame(rows, SCHEMA).filter("route = 'search'"), "route", "ts", "amount", "event_id", 20.0).collect()
    assert [r["event_id"] for r in batch] == [breach[0]]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    alerts = spark.createDataFrame([("search", "20240101", "7", 0, 5.01, 5.0)], "category string, day string, id string, at bigint, spent double, cap double")
    write = fan_out(str(tmp_path / "out"), ["1", "2"])
    write(alerts, 3), write(alerts, 3)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 2 and "Spent:</b> $5.01 (cap $5, +0%)" in found.first()["text"]
    fan_out(str(tmp_path / "none"), [])(alerts, 0)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_state_store_setting_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
        raise ValueError
    assert spark.conf.get(key) == before


def test_first_hit_windows_in_batch(spark):
    rows = [(i, START + timedelta(seconds=s), u) for i, (s, u) in enumerate([(0, "a"), (59, "a"), (60, "a"), (61, "a"), (119, "a"), (120, "a"), (5, None), (5, None), (30, "b")])]
    df = spark.createDataFrame([*rows, (99, None, "a")], "event_id bigint, ts timestamp, user string").repartition(4)
    got = {r["event_id"]: (r["index"], r["allowed"]) for r in budget.first_hit(df, "user", "ts", "event_id", 2, 60).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (1, True), 3: (2, True), 4: (3, False), 5: (1, True), 6: (1, True), 7: (2, True), 8: (1, True)}


def test_alert_text(spark):
    rows = spark.createDataFrame([("vision", 7.5, 5.0, "20241231"), ("embedding", 0.12345, 0.1, "20240228")], "c string, s double, p double, d string")
    got = [r[0] for r in rows.select(budget.alert_text(F.col("c"), F.col("s"), F.col("p"), F.col("d"), {"vision": "Vision"})).collect()]
    assert got[0].endswith("Vision\n<b>Spent:</b> $7.5 (cap $5, +50%)\n<b>Resets:</b> 2025-01-01T00:00:00.000Z")
    assert "embedding\n<b>Spent:</b> $0.1235 (cap $0.1, +23%)\n<b>Resets:</b> 2024-02-29" in got[1]


class Counted:
    """A processor's handle that counts the messages that its state costs."""

    def __init__(self):
        self.n, self.held = 0, []

    def message(self, *args):
        self.n += 1

    registerTimer = update = message

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return SimpleNamespace(get=self.message, exists=self.message, update=self.message, clear=self.message)

    def appendValue(self, value):
        self.message()
        self.held.append(value)

    def get(self):
        self.message()
        return self.held

    def clear(self):
        self.message()


def test_messages_to_the_state_do_not_grow_with_rows_and_routes():
    handle, processor = Counted(), FirstHit(60_000_000)
    processor.init(handle)
    rows = [{"row": json.dumps([str(i * 1_000_000), str(i), f"2:r{i % 5}"])} for i in range(100)]
    assert not list(processor.handleInputRows(("a", ""), iter(rows), None)) and handle.n == 2
    out = list(processor.handleExpiredTimer(("a", ""), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), None))
    assert len(out) == 100 and handle.n <= 6
    assert [(r["id"], r["index"], r["allowed"]) for r in out if r["route"] == "r1"][:4] == [("1", 1, True), ("6", 2, True), ("11", 3, False), ("16", 4, False)]
    # the next window of a route opens a minute after its last one did
    assert [r["id"] for r in out if r["index"] == 1] == [*map(str, range(5)), *map(str, range(60, 65))]


def test_limits_of_unknown_trackers_and_routes(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), user, route, None) for i, (user, route) in enumerate([(None, "x"), ("unknown", "x"), (None, "y"), (None, None), ("u", None), ("u", "x"), (None, "x")])]
    rows.append((99, START + timedelta(hours=1), "last", "x", None))
    run_in_two(spark, str(tmp_path), rows, lambda s: first_hit_limits(s, "user", "route", "ts", "event_id", {"x": 2}, 9, 60, "1 minute"), to_table(str(tmp_path / "out")))
    got = {(r["tracker"], r["route"], r["id"], r["index"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("unknown", "x", "0", 1, True), ("unknown", "x", "1", 2, True), ("unknown", "y", "2", 1, True), ("unknown", "", "3", 1, True), ("u", "", "4", 1, True), ("u", "x", "5", 1, True), ("unknown", "x", "6", 3, False)}


def test_alerts_with_null_amounts(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), "a", "search", amount) for i, amount in enumerate([None, 2.0, None, 1.0])] + [(9, START + timedelta(hours=1), "a", "list", 1.0)]
    run_in_two(spark, str(tmp_path), rows, lambda s: first_breach_alerts(s, "route", "ts", "amount", "event_id", {"search": 2.0}, "1 minute"), to_table(str(tmp_path / "out")))
    assert [(r["category"], r["id"], r["spent"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("search", "2", 2.0)]
