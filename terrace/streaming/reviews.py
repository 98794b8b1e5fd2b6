"""Streams of review events: the latest decision of each item, counts in windows, a status that follows events, and
reminders of items that wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Events that decide an item.
DECIDES = {"purchase": "COMPLETE", "error": "INVALID"}


def events(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """The event tables that arrive in a folder; ``ts`` becomes an instant, which a watermark needs."""
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_decisions(stream: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, value) of the last event of each key; an update or complete query."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last")
    return stream.groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "last.event_id", "last.value")


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; events later than the watermark are let go."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events no further apart than ``gap``."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seen = state.get if state.exists else ("PENDING", 0)
    for rows in batches:
        for kind in rows.sort_values(["ts", "event_id"])["event_type"]:
            seen += 1
            status = DECIDES.get(kind, status)
    state.update((status, seen))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "seen": [seen]})


def item_status(stream: DataFrame) -> DataFrame:
    """(user_id, status, seen) after each batch; the state of a key is two values, whatever the number of its events."""
    return stream.groupBy("user_id").applyInPandasWithState(_follow, "user_id long, status string, seen long", "status string, seen long", "update", GroupStateTimeout.NoTimeout)


class Reminders(StatefulProcessor):
    """An item waits from its first event until one decides it. Each ``wait`` that passes gives a reminder, at most ``times``, then it
    expires. The event that decides is the last by time and number, whatever the order of arrival; one that changes nothing gives no
    row. A decided item is remembered for ``keep``, so that repeated answers are known, then forgotten; so is one that expired at once,
    and its next event begins anew. State is six values an item, whatever the number of its events, and one timer."""

    def __init__(self, wait: int, times: int, keep: int):
        self.wait, self.times, self.keep = wait, times, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "status string, seen long, last long, last_id long, reminders int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        status, seen, last, last_id, reminders, due = old or ("PENDING", 0, -1, -1, 0, None)
        before, first = status if old else None, None
        for row in rows:
            seen += 1
            first = row["ms"] if first is None else min(first, row["ms"])
            decided = DECIDES.get(row["event_type"])
            if decided and (row["ms"], row["event_id"]) > (last, last_id):
                status, last, last_id = decided, row["ms"], row["event_id"]
        wanted = last + self.keep if status != "PENDING" else due or first + self.wait
        wanted = max(wanted, timerValues.getCurrentWatermarkInMs() + 1)
        if wanted != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
        self.state.update((status, seen, last, last_id, reminders, wanted))
        if status != before:
            yield Row(user_id=key[0], kind="status", status=status, n=seen, ms=last if status != "PENDING" else first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, seen, last, last_id, reminders, due = self.state.get()
        if due != at:
            return
        if status != "PENDING":
            self.state.clear()
        elif reminders < self.times:
            self.handle.registerTimer(at + self.wait)
            self.state.update((status, seen, last, last_id, reminders + 1, at + self.wait))
            yield Row(user_id=key[0], kind="reminder", status=status, n=reminders + 1, ms=at)
        else:
            self.state.clear()
            yield Row(user_id=key[0], kind="expired", status=status, n=seen, ms=at)

    def close(self) -> None:
        pass


def reminders(stream: DataFrame, wait_minutes: int = 60, times: int = 3, keep_minutes: int = 24 * 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, kind, status, n, at): changes of status with the number of events, reminders with their number, and expiries.

    Time is that of events: timers fire as the watermark passes them. An append query; the session's state store has to be RocksDB.
    """
    rows = stream.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    processor = Reminders(wait_minutes * 60_000, times, keep_minutes * 60_000)
    out = rows.groupBy("user_id").transformWithState(processor, "user_id long, kind string, status string, n long, ms long", "append", "EventTime")
    return out.select("user_id", "kind", "status", "n", F.timestamp_millis("ms").alias("at"))
