"""The write path as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.functions.text import content_hash, folded

#: Channels of a list that is broadcast.
LISTED = 100_000


def read_messages(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work through what there is, batch by batch; offsets in the checkpoint make redelivery idempotent with a keyed batch."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def deduplicated(stream: DataFrame, title: str, date: str) -> DataFrame:
    """The first message of each content hash, by the state store (unbounded state, as the event table's own)."""
    return stream.withColumn("content_hash", content_hash(F.col(title), F.col(date))).dropDuplicates(["content_hash"])


def deduplicated_within(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """As a cheap first pass: state is dropped once the watermark is past."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, clock: Callable[[int], str], source: str = "posts", buckets: int = 64) -> StreamingQuery:
    """Upsert each micro-batch into the stored events below ``path``: the buckets that it touches are written
    anew, and a batch that is delivered again changes nothing.

    The stream has channel, message_id, event_title, date, ordinal; ``clock`` gives a batch's moment by its number.
    """
    from eventloom.operators.stored_events import StoredEvents

    def batch(df: DataFrame, n: int) -> None:
        StoredEvents(df.sparkSession, path, buckets).upsert(df, clock(n), source, n)

    return run_available(stream, checkpoint, batch)


def live_posts(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel, message_id, text, ref_date) of posts (chat_id, username, message_id, text, caption, posted_at) of
    channels that are listed, by chat id or by @name, case-blind; an empty list allows all.

    A post without text or caption is left out; its day is the reference date. ``channels`` has ``channel``.
    """
    name = F.when(F.col("username") != "", F.concat(F.lit("@"), F.col("username")))
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.when(F.col("caption") != "", F.col("caption")))
    known = channels.select(folded(F.col("channel")).alias("__c")).where("__c is not null").distinct()
    rows = posts.withColumns({"__text": text, "__keys": F.array_compact(F.array(F.col("chat_id").cast("string"), folded(name)))}).where("__text is not null")
    if not known.isEmpty():
        rows = rows.join(F.broadcast(known) if known.limit(LISTED + 1).count() <= LISTED else known, F.array_contains("__keys", F.col("__c")), "left_semi")
    return rows.select(F.coalesce(name, F.col("chat_id").cast("string")).alias("channel"), "message_id", F.col("__text").alias("text"), F.col("posted_at").cast("date").alias("ref_date"))


def ingest_live(stream: DataFrame, channels: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the posts of listed channels, a folder a micro-batch; the list (Parquet) is read again with each."""

    def batch(df: DataFrame, n: int) -> None:
        listed = df.sparkSession.read.schema("channel string").parquet(channels)
        live_posts(df, listed).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return run_available(stream, checkpoint, batch)
