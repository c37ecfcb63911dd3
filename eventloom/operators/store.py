"""The event table: upserts with two levels of deduplication, moderation and retention.

State is a DataFrame in and a DataFrame out, so a batch is a copy-on-write step: read the
current version, apply, write the next. ``write_version`` does that with Parquet.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.schedule import event_start
from eventloom.functions.text import content_hash, fit
from eventloom.sources.sinks import notification_body

FIELDS = ["event_title", "date", "time", "location", "organizer", "target_audience", "event_type", "description", "language", "link", "meeting_code"]


def with_status(events: DataFrame, ids: Column, status: str, now: Column) -> DataFrame:
    return events.withColumns({"status": F.when(ids, status).otherwise(F.col("status")), "updated_at": F.when(ids, now).otherwise(F.col("updated_at"))})


def due(days: int, now: str) -> Column:
    """Approved or pending, and started at least so many days ago. The date alone narrows the scan."""
    moment = F.lit(now).cast("timestamp_ntz")
    early = F.col("date") <= F.date_sub(moment.cast("date"), days)
    started = event_start(F.col("date"), F.col("time"))
    return F.col("status").isin("approved", "pending") & early & (started <= moment - F.make_dt_interval(F.lit(days)))


def expire_due(events: DataFrame, days: int, now: str) -> DataFrame:
    return events.withColumn("status", F.when(due(days, now), "expired").otherwise(F.col("status")))


def purge_expired(events: DataFrame, days: int, today: str) -> DataFrame:
    """Without expired events older than so many days; none go if ``days`` isn't positive."""
    if days <= 0:
        return events
    old = (F.col("status") == "expired") & (F.col("date") < F.date_sub(F.lit(today).cast("date"), days))
    return events.where(~F.coalesce(old, F.lit(False)))


def cleanup(events: DataFrame, expire_days: int, purge_days: int, now: str) -> DataFrame:
    return purge_expired(expire_due(events, expire_days, now), purge_days, now[:10])


def fitted(events: DataFrame) -> DataFrame:
    return events.withColumns({c: fit(c, F.col(c)) for c in FIELDS if c in events.columns})


def merge_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by sets: the last row of a source key overwrites fields and keeps the status; a
    known content hash adds nothing; the rest are new and pending.

    Both tables have channel, message_id, event_title, date; ``batch`` also has ``ordinal``. An
    overwrite within the batch that frees a hash for a later row is not followed row by row;
    ``fold_batch`` does that. A null source key matches no row.
    """
    keyed = batch.withColumn("content_hash", content_hash(F.col("event_title"), F.col("date")))
    source = F.when(F.col("channel").isNotNull() & F.col("message_id").isNotNull(), F.struct("channel", "message_id"))
    keyed = keyed.withColumn("__key", F.coalesce(F.to_json(source), F.concat(F.lit("#"), F.col("ordinal").cast("string"))))
    # Last of a key and first of a hash by a maximum and a minimum, map-side: a common hash is no hot key.
    row = ["channel", "message_id", "event_title", "date", "content_hash"]
    last = keyed.groupBy("__key").agg(F.max(F.struct("ordinal", *row)).alias("__r")).select("__r.*")
    held = current.select("channel", "message_id", F.lit(True).alias("__exact"))
    known = current.select("content_hash").distinct().withColumn("__known", F.lit(True))
    marked = last.join(held, ["channel", "message_id"], "left").join(known, "content_hash", "left")
    over = marked.where("__exact").select("channel", "message_id", *(F.col(c).alias(f"__{c}") for c in ("event_title", "date", "content_hash")))
    changed = current.join(over, ["channel", "message_id"], "left")
    hit = F.col("__content_hash").isNotNull()
    changed = changed.select(*(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in ("event_title", "date", "content_hash") else F.col(c) for c in current.columns))
    # Of new rows with one hash the first stays.
    new = marked.where("__exact is null and __known is null").groupBy("content_hash").agg(F.min(F.struct("ordinal", "channel", "message_id", "event_title", "date")).alias("__r"))
    new = new.select("__r.channel", "__r.message_id", "__r.event_title", "__r.date", "content_hash", F.lit("pending").alias("status"))
    return changed.unionByName(new.select(*current.columns))


def fold_batch(batch: DataFrame, groups: Column) -> DataFrame:
    """The exact row-by-row upsert into an empty table, one ordered fold for each group.

    ``groups`` must put rows that can meet (by source key or content hash) into one group, as a
    micro-batch's channel does where titles are its own. A group is folded in one pass over its
    rows with two dictionaries, by one task: this is for micro-batches, ``merge_batch`` for more.
    """
    keyed = batch.withColumn("content_hash", content_hash(F.col("event_title"), F.col("date"))).withColumn("__group", groups)
    kinds = dict(keyed.dtypes)
    columns = ["ordinal", "message_id", "event_title", "date", "content_hash"]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[object, list] = {}
        uses: Counter[str] = Counter()
        for row in rows.sort_values("ordinal")[["channel", *columns]].itertuples(index=False, name=None):
            channel, ordinal, message_id, title, date, digest = row
            # A null source key matches no row.
            key = ordinal if pd.isna(channel) or pd.isna(message_id) else (channel, message_id)
            if key in held:
                uses[held[key][-1]] -= 1
                held[key][2:] = [message_id, title, date, digest]
            elif uses[digest] > 0:
                continue
            else:
                held[key] = [channel, ordinal, message_id, title, date, digest]
            uses[digest] += 1
        return pd.DataFrame(list(held.values()), columns=["channel", "id", "message_id", "event_title", "date", "content_hash"])

    schema = f"channel {kinds['channel']}, id {kinds['ordinal']}, message_id {kinds['message_id']}, event_title string, date date, content_hash string"
    return keyed.groupBy("__group").applyInPandas(fold, schema)


def patched(events: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply map patches (id, patch): only keys that are set count; title and type can't be cleared; the hash follows."""
    joined = events.join(patches.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    return apply_patch(joined).drop("__id", "patch")


def apply_patch(events: DataFrame) -> DataFrame:
    """Events with their own ``patch`` applied; a null one sets nothing."""
    out = {}
    for c in FIELDS:
        if c not in events.columns:
            continue
        given = F.col("patch")[c].cast(dict(events.dtypes)[c])
        is_set = F.coalesce(F.array_contains(F.map_keys("patch"), c), F.lit(False))
        keeps = is_set & given.isNull() if c in ("event_title", "event_type") else F.lit(False)
        out[c] = F.when(is_set & ~keeps, given).otherwise(F.col(c))
    return events.withColumns(out).withColumn("content_hash", content_hash(F.col("event_title"), F.col("date")))


def notifications(events: DataFrame, approved: Column, asof: str) -> DataFrame:
    """(id, title, body) of what is told on approval: only events of a known date that are not over."""
    place = F.col("location") if "location" in events.columns else F.lit(None).cast("string")
    body = notification_body(F.col("date"), F.col("time"), place)
    return events.where(approved & (F.col("date") >= F.lit(asof).cast("date"))).select("id", F.col("event_title").alias("title"), body.alias("body"))


def moderated(events: DataFrame, decisions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Decisions of moderators as one step: the events after it, and what is told.

    ``decisions`` has id, verdict (approve, reject, or edit), maybe notify (default true: an approved event to
    come is told) and patch (a map, for an edit, as in ``patched``). Ids of no event change nothing.
    """
    at = F.lit(now).cast("timestamp_ntz")
    notify = F.coalesce("notify", F.lit(True)) if "notify" in decisions.columns else F.lit(True)
    patch = F.col("patch") if "patch" in decisions.columns else F.lit(None).cast("map<string,string>")
    made = decisions.select(F.col("id").alias("__id"), "verdict", notify.alias("__notify"), F.when(F.col("verdict") == "edit", patch).alias("patch"))
    joined = events.join(made, F.col("id") == F.col("__id"), "left")
    approved = F.col("verdict") == "approve"
    status = F.when(approved, "approved").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    told = notifications(joined, F.coalesce(approved & F.col("__notify"), F.lit(False)), now[:10])
    # An edit that sets nothing leaves the event as it was.
    moved = F.col("verdict").isin("approve", "reject") | (F.size("patch") > 0)
    edited = apply_patch(joined.withColumns({"status": status, "updated_at": F.when(moved, at).otherwise(F.col("updated_at"))}))
    return edited.drop("__id", "verdict", "__notify", "patch"), told


def write_version(events: DataFrame, path: str, version: int) -> str:
    """The next version of the table; readers keep the one they have."""
    target = f"{path.rstrip('/')}/v={version}"
    events.write.mode("errorifexists").parquet(target)
    return target
