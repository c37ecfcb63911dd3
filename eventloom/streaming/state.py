"""Operators with state of their own: first of a hash, retention by timers, retries with waits.

Each keeps a value a key in the state store and, where time decides, a timer a key; what is
told leaves in append mode. Time comes from the stream (event time and its watermark), so that
a replay gives what the first run gave, or from the machine's clock.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventloom.functions.schedule import event_start

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State with timers and expiry needs this state store; a stream takes the setting when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work through what there is and append what is told to Parquet files."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    return query


def _moment(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).replace(tzinfo=None)


def _ms(moment: dt.datetime) -> int:
    return round(moment.replace(tzinfo=dt.UTC).timestamp() * 1000)


class _FirstOfHash(StatefulProcessor):
    """The first surviving event of a hash is saved; each later one is a duplicate of it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "index long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.first.get() if self.first.exists() else None
        for r in sorted(rows, key=lambda r: (r["index"], r["ordinal"])):
            if r["gate"] is not None:
                # A filtered event does not occupy the slot.
                yield Row(index=r["index"], ordinal=r["ordinal"], fate=r["gate"], first_index=None)
            elif held is None:
                held = (r["index"],)
                self.first.update(held)
                yield Row(index=r["index"], ordinal=r["ordinal"], fate="saved", first_index=None)
            else:
                yield Row(index=r["index"], ordinal=r["ordinal"], fate="duplicate", first_index=held[0])

    def close(self) -> None:
        pass


def first_of_hash(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(index, ordinal, fate, first_index) of a stream of (index, ordinal, content_hash, gate): ``gate`` is why
    an event was filtered before, or null.

    Rows that come in one micro-batch are ordered by index and ordinal, micro-batches as they
    come. State is a number a hash; with ``ttl_ms`` a hash that old (by the machine's clock) is
    forgotten and its next event is saved again; such a stream runs until it is stopped.
    """
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.groupBy("content_hash").transformWithState(_FirstOfHash(ttl_ms), "index long, ordinal long, fate string, first_index long", "Append", mode)


class _Retention(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "status string, expire_at timestamp, purge_at timestamp")

    def _told(self, key: tuple, now: int) -> Iterator[Row]:
        """What is due by now; a timer for what is due next."""
        status, expire_at, purge_at = self.event.get()
        if status in ("approved", "pending") and expire_at is not None:
            if _ms(expire_at) > now:
                self.handle.registerTimer(_ms(expire_at))
                return
            status = "expired"
            self.event.update((status, expire_at, purge_at))
            yield Row(id=key[0], status="expired", at=expire_at)
        if status == "expired" and purge_at is not None:
            if _ms(purge_at) > now:
                self.handle.registerTimer(_ms(purge_at))
                return
            self.event.clear()
            yield Row(id=key[0], status="purged", at=max(purge_at, expire_at or purge_at))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r["seen_at"])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.event.update((last["status"], last["expire_at"], last["purge_at"]))
        yield from self._told(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.event.exists():
            yield from self._told(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def retention(stream: DataFrame, expire_days: int, purge_days: int) -> DataFrame:
    """(id, status, at) of a stream of (id, date, time, status, seen_at): events that expire, and expired ones
    that are purged, as the watermark of ``seen_at`` passes the moment; none are purged if ``purge_days`` isn't positive.

    The state of an event is its status and two moments, and goes when it is purged. A row that
    comes again (moderated, edited) takes the place of the one before.
    """
    start = event_start(F.col("date"), F.col("time"))
    # An event goes on the day after so many days have passed.
    purge: Column = F.date_add("date", purge_days + 1).cast("timestamp_ntz") if purge_days > 0 else F.lit(None).cast("timestamp_ntz")
    rows = stream.select("id", "status", (start + F.make_dt_interval(F.lit(expire_days))).cast("timestamp").alias("expire_at"), purge.cast("timestamp").alias("purge_at"), F.col("seen_at").cast("timestamp").alias("seen_at"))
    return rows.withWatermark("seen_at", "0 seconds").groupBy("id").transformWithState(_Retention(), "id long, status string, at timestamp", "Append", "EventTime")


class _Retries(StatefulProcessor):
    def __init__(self, attempt: Callable[[Row, int], str | None], columns: str, backoff_seconds: int, max_attempts: int, by_clock: bool):
        self.attempt, self.columns, self.backoff, self.most, self.by_clock = attempt, columns, backoff_seconds, max_attempts, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"attempts int, {self.columns}")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()

    def _tried(self, key: tuple, values: dict, n: int, at: int, now: int) -> Iterator[Row]:
        """The attempts that are due by now, the first of them at ``at``; after a failure, the state and timer of the next."""
        while True:
            error = self.attempt(Row(**values), n)
            over = n >= self.most
            yield Row(id=key[0], attempts=n, status="done" if error is None else "failed" if over else "queued", at=_moment(at), error=error)
            if error is None or over:
                self.waiting.clear()
                return
            at += 1000 * self.backoff * 2 ** (n - 1)
            if at > now:
                self.waiting.update((n, *values.values()))
                self.handle.registerTimer(at)
                return
            n += 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self._now(timerValues)
        for r in rows:
            if not self.waiting.exists():
                values = {c: r[c] for c in r.asDict() if c not in ("id", "submitted_at")}
                yield from self._tried(key, values, 1, now if self.by_clock else _ms(r["submitted_at"]), now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            n, *values = self.waiting.get()
            names = [c.split()[0] for c in self.columns.split(", ")]
            due, now = expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues)
            yield from self._tried(key, dict(zip(names, values, strict=True)), n + 1, now if self.by_clock else due, max(due, now))

    def close(self) -> None:
        pass


def with_retries(stream: DataFrame, attempt: Callable[[Row, int], str | None], columns: str, backoff_seconds: int, max_attempts: int, by_clock: bool = False) -> DataFrame:
    """(id, attempts, status, at, error), a row an attempt, of a stream of (id, submitted_at and ``columns``).

    ``attempt`` gets a row's columns and the number of the attempt, and returns what went wrong or
    None. A failed row waits in the state, twice as long each time, comes again when its timer is
    due, and is given up after ``max_attempts``. While one waits, another row of its id adds nothing, as in
    ``jobs.enqueue``. Timers go by the watermark of ``submitted_at``, or by the machine's clock: then
    the stream runs until it is stopped.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    rows = stream.select("id", F.col("submitted_at").cast("timestamp").alias("submitted_at"), *names)
    if not by_clock:
        rows = rows.withWatermark("submitted_at", "0 seconds")
    processor = _Retries(attempt, columns, backoff_seconds, max_attempts, by_clock)
    return rows.groupBy("id").transformWithState(processor, "id long, attempts int, status string, at timestamp, error string", "Append", "ProcessingTime" if by_clock else "EventTime")
