"""Messages from JSON lines, JSON arrays and chat exports, with warnings as a second table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBJECT = "source_message_id string, id string, source_channel string, channel string, date string, text string, _expect string"
MESSAGE = ["message_id", "date", "text", "channel", "note"]
PART = "array<struct<type string, text string>>"


def _message(obj: Column, index: Column, today: str) -> list[Column]:
    """Id, else the place in the file; channel, else ``@sample``; a bad date is today's."""
    date = F.substring(obj["date"], 1, 10).try_cast("date")
    return [
        F.coalesce(obj["source_message_id"].try_cast("long"), obj["id"].try_cast("long"), index).alias("message_id"),
        F.coalesce(date, F.lit(today).cast("date")).alias("date"),
        F.trim(obj["text"]).alias("text"),
        F.coalesce(obj["source_channel"], obj["channel"], F.lit("@sample")).alias("channel"),
        F.coalesce(obj["_expect"], F.lit("")).alias("note"),
        date.isNull().alias("__today"),
    ]


def _checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    problem = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text, left out").when(F.col("__today"), "no readable date, taken as today's")
    warned = rows.withColumn("warning", problem)
    good = warned.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return good.select(*MESSAGE), warned.where("warning is not null").select("message_id", "warning")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at): the lines of text files with their place (from 1) in the file, however a file is split.

    Lines are counted in each split; a split starts where the counts of those before it end.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("line", (F.col("id") + F.col("shift") + 1).alias("at"))


def load_jsonl(spark: SparkSession, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """A JSON object a line; blank lines and those that start with # are skipped."""
    kept = numbered_lines(spark, path).where(~F.col("line").rlike(r"^\s*(#|$)"))
    objects = kept.select("at", F.from_json("line", OBJECT).alias("o"))
    return _checked(objects.select(*_message(F.col("o"), F.col("at"), today)))


def load_array(spark: SparkSession, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """One JSON array of objects, pretty-printed or not."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), f"array<struct<{OBJECT}>>").alias("a"))
    objects = whole.select(F.posexplode("a").alias("at", "o"))
    return _checked(objects.select(*_message(F.col("o"), (F.col("at") + 1).cast("long"), today)))


def flatten_text(raw: Column) -> Column:
    """A string, or a list of strings and of parts with a text, as one string."""
    items = F.from_json(raw, "array<string>")
    texts = F.transform(items, lambda x: F.when(x.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x))
    return F.when(raw.rlike(r"^\s*\["), F.array_join(texts, "")).otherwise(raw)


def load_export(spark: SparkSession, path: str) -> DataFrame:
    """A chat export: messages proper with a text and a readable date."""
    schema = "name string, id string, messages array<struct<id:string,type:string,date:string,text:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), schema).alias("e"))
    rows = whole.select(F.coalesce("e.name", "e.id", F.lit("export")).alias("channel"), F.explode("e.messages").alias("m"))
    rows = rows.where("m.type = 'message'").select(
        F.col("m.id").try_cast("long").alias("message_id"), F.substring("m.date", 1, 10).try_cast("date").alias("date"),
        F.trim(flatten_text(F.col("m.text"))).alias("text"), "channel", F.lit("").alias("note"),
    )
    return rows.where("text <> '' and date is not null")


def load_messages(spark: SparkSession, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """Whatever of the three the file is, by its first line that says something.

    Lines of JSON may be of any number; an array or an export is one value, so one task reads
    the whole file, of at most the 2 GB that a row can hold.
    """
    lines = spark.read.text(path).select(F.ltrim(F.regexp_replace("value", "^\ufeff", "")).alias("line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    head = lines.select(
        F.substring("line", 1, 1).alias("first"), F.get_json_object("line", "$.messages").isNotNull().alias("export"), F.get_json_object("line", "$").isNotNull().alias("whole")
    ).first()
    if head is None:
        empty = spark.createDataFrame([], "message_id long, date date, text string, channel string, note string")
        return empty, spark.createDataFrame([(None, "the file is empty")], "message_id long, warning string")
    if head["first"] == "[":
        return load_array(spark, path, today)
    if head["first"] == "{" and (head["export"] or not head["whole"]):
        return load_export(spark, path), spark.createDataFrame([], "message_id long, warning string")
    return load_jsonl(spark, path, today)


def manual_posts(posts: DataFrame) -> DataFrame:
    """Posts that an admin sends by hand (chat_id, message_id, text, caption, origin_date, date): a forwarded post keeps the
    date of its origin; the channel names the chat; posts without any text are left out."""
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.when(F.col("caption") != "", F.col("caption")))
    return posts.where(text.isNotNull()).select(
        "message_id", F.concat(F.lit("manual:"), F.col("chat_id").cast("string")).alias("channel"), text.alias("text"), F.coalesce("origin_date", "date").cast("date").alias("ref_date")
    )


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n of a history, in order."""
    return messages.orderBy(F.desc("message_id")).limit(n).orderBy("message_id")
