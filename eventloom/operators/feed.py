"""The public feed and the keyset change feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.rules import all_of

STATUSES = ["pending", "approved", "rejected", "expired"]


def guard(name: str, value: int, least: int, most: int | None = None) -> int:
    if value < least or (most is not None and value > most):
        raise ValueError(f"{name} is {value}; it must be {least} or more" + (f" and {most} or less" if most is not None else ""))
    return value


def feed_filter(
    status: str | None = "approved", event_type: str | None = None, date_from: str | None = None, date_to: str | None = None,
    upcoming: bool = False, asof: str | None = None,
) -> Column:
    """One predicate for page and count. A null date meets no date condition."""
    if status not in (None, "all", *STATUSES):
        raise ValueError(f"no such status: {status}")
    kept = []
    if status not in (None, "all"):
        kept.append(F.col("status") == status)
    if upcoming:
        kept.append(F.col("date") >= F.lit(asof).cast("date"))
    if date_from:
        kept.append(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        kept.append(F.col("date") <= F.lit(date_to).cast("date"))
    if event_type:
        kept.append(F.col("event_type") == event_type)
    return all_of(kept)


def feed(events: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """A page by date (unknown ones last) and id; Spark takes the top rows without a full sort."""
    guard("limit", limit, 1, 500)
    guard("offset", offset, 0)
    ordered = events.where(feed_filter(**filters)).orderBy(F.col("date").asc_nulls_last(), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def feed_count(events: DataFrame, **filters) -> DataFrame:
    return events.where(feed_filter(**filters)).agg(F.count(F.lit(1)).alias("total"))


def encode_cursor(updated_at: Column, row_id: Column) -> Column:
    return F.concat(F.date_format(updated_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("|"), row_id.cast("string"))


def decode_cursor(cursor: str) -> tuple[dt.datetime, int]:
    moment, bar, row_id = cursor.rpartition("|")
    if not bar:
        raise ValueError(f"not a cursor: {cursor!r}")
    return dt.datetime.fromisoformat(moment), int(row_id)


def cursor_columns(cursor: Column) -> tuple[Column, Column]:
    """Moment and id of a cursor column; null where malformed."""
    moment = F.substring_index(cursor, "|", 1).try_cast("timestamp_ntz")
    return moment, F.substring_index(cursor, "|", -1).try_cast("long")


def changed_since(events: DataFrame, cursor: str | None = None, statuses: tuple[str, ...] = ("approved", "rejected", "expired"), limit: int = 100) -> DataFrame:
    """The next changes by (updated_at, id) after the cursor; the predicate reaches the scan."""
    guard("limit", limit, 1, 1000)
    rows = events.where(F.col("status").isin(*statuses))
    if cursor:
        moment, last = decode_cursor(cursor)
        at = F.lit(moment.isoformat()).cast("timestamp_ntz")
        rows = rows.where((F.col("updated_at") > at) | ((F.col("updated_at") == at) & (F.col("id") > last)))
    return rows.orderBy("updated_at", "id").limit(limit)


def sync_page(events: DataFrame, server_time: dt.datetime, cursor: str | None = None, limit: int = 100) -> dict:
    """A page for a client: changed rows, removed ids, and where to go on. At most ``limit`` rows come to the driver."""
    rows = changed_since(events, cursor, limit=limit).collect()
    more = len(rows) == limit
    last = f"{rows[-1]['updated_at'].isoformat()}|{rows[-1]['id']}" if more else f"{server_time.isoformat()}|0"
    approved = [r for r in rows if r["status"] == "approved"]
    return {"cursor": last, "has_more": more, "changed": approved, "removed": [r["id"] for r in rows if r["status"] != "approved"]}


def status_counts(events: DataFrame) -> DataFrame:
    """Rows by status, the four known ones always there, and a total of all."""
    spark = events.sparkSession
    counted = events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    each = known.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return each.unionByName(counted.agg(F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
