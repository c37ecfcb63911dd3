"""The engine's facade: one method for each thing that a client asks for, a DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import feed, jobs, store


class Engine:
    """Over an event table and a job table; changes return the next version of a table."""

    def __init__(self, events: DataFrame, queue: DataFrame):
        self.events, self.queue = events, queue

    def feed(self, **filters) -> DataFrame:
        """The public page: without the raw text."""
        return feed.feed(self.events.drop("raw_text"), **filters)

    def feed_count(self, **filters) -> DataFrame:
        return feed.feed_count(self.events, **filters)

    def changes(self, cursor: str | None = None, limit: int = 100) -> DataFrame:
        return feed.changed_since(self.events, cursor, limit=limit)

    def event_detail(self, event_id: int) -> DataFrame:
        return self.events.where(F.col("id") == event_id)

    def job(self, job_id: int) -> DataFrame:
        return self.queue.where(F.col("id") == job_id)

    def jobs(self, status: str | None = None, limit: int = 50) -> DataFrame:
        return jobs.recent(self.queue, limit, status)

    def stats(self) -> tuple[DataFrame, DataFrame]:
        return feed.status_counts(self.events), jobs.queue_stats(self.queue)

    def enqueue(self, messages: DataFrame) -> DataFrame:
        return jobs.enqueue(self.queue, messages)

    def approve(self, ids: list[int], now: str) -> DataFrame:
        return store.with_status(self.events, F.col("id").isin(ids), "approved", F.lit(now).cast("timestamp_ntz"))

    def reject(self, ids: list[int], now: str) -> DataFrame:
        return store.with_status(self.events, F.col("id").isin(ids), "rejected", F.lit(now).cast("timestamp_ntz"))

    def edit(self, patches: DataFrame) -> DataFrame:
        return store.patched(self.events, patches)

    def cleanup(self, expire_days: int, purge_days: int, now: str) -> DataFrame:
        return store.cleanup(self.events, expire_days, purge_days, now)
