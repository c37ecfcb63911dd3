"""Upserts with exactly the result of one row after the other, by sets.

Row by row: a row whose source key is in the table overwrites that key's row; else a row whose
content hash some row of the table has adds nothing; else it is inserted. An overwrite frees
one hash and takes another, so what a row does depends on earlier rows, through keys and
hashes in turn, across all channels.

What is unknown of a key is only its first inserted row; from then on each of its rows
overwrites. A row then holds its hash until the next row of its key. So, given the first rows of all
keys, a row is refused if among earlier rows of its hash that count one holds it still:
a running maximum. From that follow new first rows. Rounds go on until none changes; a row's
fate is settled at the latest one round after all earlier rows it depends on, so the end is
the one fixed point, which is the row-by-row result. The number of rounds is the length of
the longest chain of fates, not the size of a group.

Running values go by blocks of ordinals: no task holds more than a block of one key or hash,
however common it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import content_hash
from eventloom.sources.scratch import written

#: Rows of a block, roughly; ordinals should be spread evenly.
BLOCK_ROWS = 50_000
_NEVER = 2**63 - 1


def source_key(row_id: Column) -> Column:
    """A text for the source key; a null one matches no row."""
    whole = F.col("channel").isNotNull() & F.col("message_id").isNotNull()
    return F.when(whole, F.to_json(F.struct("channel", "message_id"))).otherwise(F.concat(F.lit("#"), row_id.cast("string")))


def _held_until(rows: DataFrame) -> DataFrame:
    """Add ``until``: the ordinal of the key's next row."""
    inside = Window.partitionBy("key", "block").orderBy("ordinal")
    firsts = rows.groupBy("key", "block").agg(F.min("ordinal").alias("first"))
    after = F.lead("first").over(Window.partitionBy("key").orderBy("block")).alias("after")
    nexts = firsts.select("key", "block", after)
    joined = rows.withColumn("__next", F.lead("ordinal").over(inside)).join(nexts, ["key", "block"])
    return joined.withColumn("until", F.coalesce("__next", "after", F.lit(_NEVER))).drop("__next", "after")


def _first_rows(rows: DataFrame, spread: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, first): each key's first row that no hash refuses, if ``firsts`` were the first rows of all keys."""
    by_block = spread.join(firsts, "key")
    counted = rows.join(by_block, ["key", "block"], "left").withColumn("held", F.when(F.col("ordinal") >= F.col("first"), F.col("until"))).drop("first")
    inside = Window.partitionBy("hash", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("hash", "block").agg(F.max("held").alias("__m")).select("hash", "block", F.max("__m").over(earlier).alias("before"))
    known = counted.withColumn("__here", F.max("held").over(inside)).join(blocks, ["hash", "block"])
    refused = F.coalesce(F.greatest("__here", "before"), F.lit(-1)) > F.col("ordinal")
    return known.where(~refused).groupBy("key").agg(F.min("ordinal").alias("first"))


def exact_upserts(batch: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """channel, id, message_id, event_title, date, content_hash: the table after all rows, the same as ``store.fold_batch``
    gives for one group, without the group.

    ``batch`` has channel, message_id, event_title, date and ordinal, which is unique. An existing
    table goes before the batch, with lower ordinals.
    """
    hashed = batch.select("channel", "message_id", "event_title", "date", "ordinal", content_hash(F.col("event_title"), F.col("date")).alias("content_hash"))
    whole = written(hashed.withColumn("key", source_key(F.col("ordinal"))))
    n, low, high = whole.agg(F.count(F.lit(1)), F.min("ordinal"), F.max("ordinal")).first()
    blocks = max(1, -(-n // block_rows))
    block = F.floor((F.col("ordinal") - (low or 0)).cast("double") * blocks / ((high or 0) - (low or 0) + 1)) if n else F.lit(0)
    rows = written(_held_until(whole.select("key", F.col("content_hash").alias("hash"), F.col("ordinal").cast("long").alias("ordinal"), block.cast("long").alias("block"))))
    spread = written(rows.select("key", "block").distinct())
    firsts = written(rows.groupBy("key").agg(F.min("ordinal").alias("first")))
    while True:
        after = written(_first_rows(rows, spread, firsts))
        changed = firsts.join(after.withColumnRenamed("first", "now"), "key", "full").where(~F.col("first").eqNullSafe(F.col("now")))
        firsts = after
        if changed.isEmpty():
            break
    last = whole.groupBy("key").agg(F.max(F.struct("ordinal", "channel", "message_id", "event_title", "date", "content_hash")).alias("r"))
    return firsts.join(last, "key").select("r.channel", F.col("first").alias("id"), "r.message_id", "r.event_title", "r.date", "r.content_hash")
