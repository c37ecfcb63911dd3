"""The event table as a stored one: upserts, moderation and retention by the buckets they touch.

Beside the events stands an index of their content hashes with the number of rows of each, so
that an upsert finds a known hash, in whatever channel, without reading the table. Both are
buckets of one store and change in one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import content_hash
from eventloom.operators import feed, store
from eventloom.sources.stored import Store, Table

EVENTS = "id long, channel string, message_id long, event_title string, date date, time string, content_hash string, status string, updated_at timestamp_ntz"
HASHES = "content_hash string, rows long"


class StoredEvents:
    """Events that are changed by batches; every change is logged and told once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.store = Store(
            spark, path, [Table("events", EVENTS, "id", ("channel", "message_id"), buckets, logged=True), Table("hashes", HASHES, "content_hash", ("content_hash",), buckets)]
        )

    def read(self) -> DataFrame:
        return self.store.read("events")

    def upsert(self, batch: DataFrame, now: str | Column, source: str | None = None, number: int = 0) -> dict[str, list[int]]:
        """As ``store.merge_batch``: the last row of a source key overwrites the fields and keeps status
        and id; a known content hash adds nothing; the rest are new, pending, and take ``ordinal`` as id.

        ``batch`` has channel, message_id, event_title, date, ordinal (unique in the table's life)
        and maybe time. A batch ``number`` of a ``source`` counts once, however often it is delivered.
        """
        s = self.store
        if source is not None and s.seen(source, number):
            return {"events": [], "hashes": []}
        now = F.lit(now) if isinstance(now, str) else now
        time = F.col("time") if "time" in batch.columns else F.lit(None).cast("string")
        row = batch.select("channel", "message_id", "event_title", "date", time.alias("time"), F.col("ordinal").alias("id"), now.cast("timestamp_ntz").alias("updated_at"))
        row = row.withColumn("content_hash", content_hash(F.col("event_title"), F.col("date")))
        whole = F.col("channel").isNotNull() & F.col("message_id").isNotNull()
        key = F.when(whole, F.to_json(F.struct("channel", "message_id"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
        names = ["id", "channel", "message_id", "event_title", "date", "time", "content_hash", "updated_at"]
        last = s.staged("last", row.withColumn("__key", key).groupBy("__key").agg(F.max(F.struct(*names)).alias("r")).select("r.*"))
        held = s.near("events", last).select(F.col("id").alias("__id"), "channel", "message_id", F.col("status").alias("__status"), F.col("content_hash").alias("__old"))
        known = s.near("hashes", last).select("content_hash", F.lit(True).alias("__known"))
        marked = last.join(held, ["channel", "message_id"], "left").join(known, "content_hash", "left")
        exact = F.col("__id").isNotNull()
        over = marked.where(exact).withColumns({"id": F.col("__id"), "status": F.col("__status")})
        fresh = marked.where(~exact & F.col("__known").isNull())
        # Of new rows with one hash the first stays.
        first = fresh.groupBy("content_hash").agg(F.min(F.struct(*(n for n in names if n != "content_hash"))).alias("r")).select("content_hash", "r.*")
        new = first.withColumns({"status": F.lit("pending"), "__old": F.lit(None).cast("string")})
        columns = ["id", "channel", "message_id", "event_title", "date", "time", "content_hash", "status", "updated_at"]
        put = s.staged("put", over.select(*columns, "__old").unionByName(new.select(*columns, "__old")))
        return s.commit({"events": (put.select(*columns), None), "hashes": self._recounted(put.select("content_hash", "__old"))}, source, number)

    def _recounted(self, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index rows to put and to take, from (content_hash after, __old before), null where there is none."""
        s = self.store
        deltas = moved.where("content_hash is not null").select("content_hash", F.lit(1).alias("n"))
        deltas = deltas.unionByName(moved.where("__old is not null").select(F.col("__old").alias("content_hash"), F.lit(-1).alias("n")))
        deltas = s.staged("deltas", deltas.groupBy("content_hash").agg(F.sum("n").alias("n")).where("n <> 0"))
        counted = deltas.join(s.near("hashes", deltas), "content_hash", "left").select("content_hash", (F.coalesce("rows", F.lit(0)) + F.col("n")).alias("rows"))
        counted = s.staged("counted", counted)
        return counted.where("rows > 0"), counted.where("rows <= 0")

    def set_status(self, which: Column, status: str, now: str) -> dict[str, list[int]]:
        """Moderation: rows that meet the condition and have another status get it."""
        rows = self.read().where(which & (F.col("status") != status)).withColumns({"status": F.lit(status), "updated_at": F.lit(now).cast("timestamp_ntz")})
        return self.store.commit({"events": (self.store.staged("put", rows), None)})

    def cleanup(self, expire_days: int, purge_days: int, now: str) -> dict[str, list[int]]:
        """Retention in one version: what is due expires, what expired long ago goes, and its hash is free again."""
        s, events = self.store, self.read()
        at = F.lit(now).cast("timestamp_ntz")
        due = events.where(store.due(expire_days, now)).withColumns({"status": F.lit("expired"), "updated_at": at})
        old = F.col("date") < F.date_sub(at.cast("date"), purge_days) if purge_days > 0 else F.lit(False)
        put = s.staged("put", due.where(~F.coalesce(old, F.lit(False))))
        expired = F.when(store.due(expire_days, now), "expired").otherwise(F.col("status")) == "expired"
        take = s.staged("take", events.where(expired & F.coalesce(old, F.lit(False))))
        freed = take.select(F.lit(None).cast("string").alias("content_hash"), F.col("content_hash").alias("__old"))
        return s.commit({"events": (put, take), "hashes": self._recounted(freed)})


def latest_of_log(log: DataFrame) -> DataFrame:
    """The event table that a change log tells: of each id the last change, without the deleted."""
    columns = [c for c in log.columns if c not in ("op", "v")]
    last = log.groupBy("id").agg(F.max_by(F.struct("op", *(c for c in columns if c != "id")), "v").alias("r"))
    return last.where("r.op <> 'delete'").select("id", "r.*").select(*columns)


def changes_from_log(log: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """A page of the change feed from the log alone: the same rows as ``feed.changed_since`` on the table."""
    return feed.changed_since(latest_of_log(log), cursor, limit=limit)
