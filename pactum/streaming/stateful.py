"""Streaming operators with state that ends: timers in event time close windows, feeds and idle keys.

Every processor keeps a few numbers for a key and sets one timer; when the watermark passes it, the state goes, or, for
ratings that no news came of, a row is given out. Rows later than the watermark are dropped before, so no row can ask
for state that a timer has removed. Within a trigger a key's rows are put in time order; what a task holds of a key is
what one trigger brought of it, which the source's limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from pactum.operators.ops import FINAL_STATUSES, TIMEOUT_MESSAGE

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
FEED_MS = 10 * 60_000
RUNNING = ("extracting", "analysing")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "Append") -> DataFrame:
    """The processor over the rows of each key, in event time. Its kind of state needs the RocksDB store."""
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime"
    )


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    parts = list(rows)
    return (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(list(by), kind="stable")


class Timed(StatefulProcessor):
    """One value for a key, and one timer that ends it."""

    columns = StructType()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.columns)

    def held(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def hold(self, value: tuple, until_ms: int) -> None:
        """Keeps the value until the watermark passes until_ms, which takes the place of an earlier time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.value.update(value)
        self.handle.registerTimer(int(until_ms))

    def drop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.value.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Acceptance(Timed):
    """Times (microseconds) of the uploads that count: at most ``limit``; gone a day after the last."""

    columns = StructType().add("taken", ArrayType(LongType()))

    def __init__(self, limit: int):
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        taken = [int(t) for t in held[0]] if held else []
        rows = in_order(rows, "us", "event_id")
        flags = []
        for us in rows["us"]:
            taken = [t for t in taken if t > us - DAY_MS * 1000]
            flags.append(len(taken) < self.limit)
            if flags[-1]:
                taken.append(int(us))
        if taken:
            self.hold((taken,), taken[-1] // 1000 + DAY_MS + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": flags})


class RequestWindow(Timed):
    """Start and count of a user's open window; gone when the window has closed."""

    columns = StructType().add("start", LongType()).add("count", LongType())

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.held() or (None, 0)
        rows = in_order(rows, "ms", "event_id")
        waits = []
        for ms in rows["ms"].tolist():
            start, count, wait = take(start, count, ms, self.limit, self.window_ms)
            waits.append(wait)
        self.hold((start, count), start + self.window_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "retry_after_seconds": waits})


def take(start: int | None, count: int, ms: int, limit: int, window_ms: int) -> tuple[int, int, int]:
    """The window after a request, and the seconds that the request has to wait (0: it counts)."""
    if start is None or ms - start >= window_ms:
        return ms, 1, 0
    if count >= limit:
        return start, count, -(-(start + window_ms - ms) // 1000)
    return start, count + 1, 0


class StatusFeed(Timed):
    """Last status of an open feed and when it stops; a closed feed is remembered for ``keep_ms`` and then forgotten."""

    columns = StructType().add("last", StringType()).add("stops", LongType())

    def __init__(self, feed_ms: int, keep_ms: int):
        self.feed_ms, self.keep_ms = feed_ms, keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, stops = self.held() or (None, None)
        rows = in_order(rows, "us", "seq")
        kept = []
        for row in rows.itertuples():
            ms = row.us // 1000
            stops = ms + self.feed_ms if stops is None else stops
            if last in FINAL_STATUSES or ms >= stops:
                continue
            if row.status != last:
                kept.append((key[0], row.status, row.seq))
                last = row.status
        self.hold((last, stops), stops + self.keep_ms)
        yield pd.DataFrame(kept, columns=["rating_id", "status", "seq"])


class LatestStatus(Timed):
    """The latest status of a rating, given out when it changes; forgotten ``keep_ms`` after the last news."""

    columns = StructType().add("us", LongType()).add("seq", LongType()).add("status", StringType())

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        row = in_order(rows, "us", "seq").iloc[-1]
        latest = int(row["us"]), int(row["seq"]), row["status"]
        if held is None or latest[:2] > (held[0], held[1]):
            self.hold(latest, latest[0] // 1000 + self.keep_ms)
            yield pd.DataFrame([(key[0], latest[2], pd.Timestamp(latest[0], unit="us", tz="UTC"))], columns=["rating_id", "status", "at"])
        else:
            yield pd.DataFrame()


class Stuck(Timed):
    """Created and started times of a rating that is not final; its timer fires when no news came for too long."""

    columns = StructType().add("status", StringType()).add("created", LongType()).add("started", LongType()).add("us", LongType()).add("seq", LongType())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, created, started, last_us, last_seq = self.held() or (None, None, None, -1, -1)
        for row in in_order(rows, "us", "seq").itertuples():
            ms = row.us // 1000
            created = ms if created is None else min(created, ms)
            if row.status == "extracting" or (row.status in RUNNING and started is None):
                started = ms if started is None else max(started, ms)
            if (row.us, row.seq) > (last_us, last_seq):
                status, last_us, last_seq = row.status, int(row.us), int(row.seq)
        if status in FINAL_STATUSES:
            self.drop()
        else:
            waits = started + HOUR_MS if status in RUNNING else created + DAY_MS
            self.hold((status, created, started, last_us, last_seq), waits + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - 1, unit="ms", tz="UTC")
        yield pd.DataFrame(
            [(key[0], "failed", "timeout", TIMEOUT_MESSAGE, at)], columns=["rating_id", "status", "error_code", "error", "due_at"]
        )


def _history(history: DataFrame, delay: str) -> DataFrame:
    return history.withWatermark("at", delay).select("rating_id", "status", "seq", "at", F.unix_micros("at").alias("us"))


def accept_uploads(events: DataFrame, limit: int, delay: str) -> DataFrame:
    rows = events.where("action = 'upload'").withWatermark("at", delay).select("user_id", "event_id", "at", F.unix_micros("at").alias("us"))
    return stateful(rows, "user_id", Acceptance(limit), "user_id long, event_id long, accepted boolean")


def request_window(events: DataFrame, limit: int, window_ms: int, delay: str) -> DataFrame:
    rows = events.withWatermark("at", delay).select("user_id", "event_id", "at", F.unix_millis("at").alias("ms"))
    return stateful(rows, "user_id", RequestWindow(limit, window_ms), "user_id long, event_id long, retry_after_seconds long")


def status_feed(history: DataFrame, delay: str, feed_ms: int = FEED_MS, keep_ms: int = DAY_MS) -> DataFrame:
    return stateful(_history(history, delay), "rating_id", StatusFeed(feed_ms, keep_ms), "rating_id long, status string, seq long")


def live_status(history: DataFrame, delay: str, keep_ms: int = DAY_MS) -> DataFrame:
    """rating_id, status and at whenever a rating's latest status changes; update mode."""
    return stateful(_history(history, delay), "rating_id", LatestStatus(keep_ms), "rating_id long, status string, at timestamp", "Update")


def stuck_ratings(history: DataFrame, delay: str) -> DataFrame:
    """rating_id, status (failed), error_code, error and due_at of ratings that no news came of: an hour after their last
    attempt started, a day after they were queued. A rating that ends in time gives nothing; one that goes on after
    its failure is followed anew."""
    schema = "rating_id long, status string, error_code string, error string, due_at timestamp"
    return stateful(_history(history, delay), "rating_id", Stuck(), schema)
