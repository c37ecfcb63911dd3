"""Summaries of runs, verdicts and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FATES = ["saved", "duplicate", "filtered", "individual", "stale", "language"]


def upper_median(n: Column) -> Column:
    """The place (from 0) of the middle of n sorted values, the upper one of two: by index, not interpolated."""
    return F.floor(n / 2)


def p95(n: Column) -> Column:
    return F.least(n - 1, F.floor(n * 0.95))


def placed_values(df: DataFrame, by: str, value: str, places: dict[str, Callable[[Column], Column]], width: float = 1.0) -> DataFrame:
    """One row a group: the values at places of its sorted values, each place a function of their number.

    Values are counted (map-side first) by ranges of ``width``; running sums over a group's
    ranges tell in which one a place lies, and only the values of that range are put in order.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(by, F.floor(v / width).alias("__r"), v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranges = counts.groupBy(by, "__r").agg(F.sum("__c").alias("__in"))
    of = Window.partitionBy(by).orderBy("__r")
    ranges = ranges.withColumn("__before", F.sum("__in").over(of) - F.col("__in")).withColumn("__n", F.sum("__in").over(Window.partitionBy(by)))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("__n")).cast("long").alias("at")) for k, f in places.items()))
    aims = ranges.select(by, "__r", "__before", "__in", F.explode(wanted).alias("x"))
    aims = aims.where((F.col("x.at") >= F.col("__before")) & (F.col("x.at") < F.col("__before") + F.col("__in")))
    aims = aims.select(by, "__r", F.col("x.name").alias("__name"), (F.col("x.at") - F.col("__before")).alias("__at"))
    inside = counts.join(aims, [by, "__r"])
    inside = inside.withColumn("__upto", F.sum("__c").over(Window.partitionBy(by, "__name").orderBy("__v")))
    found = inside.where((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__c")))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in places))


def medians(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """The median of each group, between the two middle values of an even number; groups without a value have no row."""
    middle = placed_values(df, by, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)})
    return middle.select(by, ((F.col("__low") + F.col("__high")) / 2).alias(name))


def run_stats(runs: DataFrame) -> DataFrame:
    """One row: answers, their median and longest time (of those that took any; 0 for none), first turns."""
    timed = runs.where(F.col("seconds") > 0).select(F.lit(1).alias("one"), "seconds")
    total = runs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("most"), F.count_if(F.col("turn") == 0).alias("first_turns")).withColumn("one", F.lit(1))
    joined = total.join(medians(timed, "one", "seconds"), "one", "left")
    return joined.select("n", F.coalesce("median", F.lit(0.0)).alias("median"), "most", "first_turns")


def latency_table(runs: DataFrame, by: str, seconds: str) -> DataFrame:
    timed = runs.where(F.col(seconds) > 0)
    s = F.col(seconds)
    totals = timed.groupBy(by).agg(F.avg(s).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), (F.sum(s) / 60).alias("minutes"))
    return placed_values(timed, by, seconds, {"median": upper_median, "p95": p95}).join(totals, by)


def bench_summary(runs: DataFrame) -> DataFrame:
    """Runs of one kind are right if a trap has no event and anything else has one; latency only of those without error."""
    good = F.when(F.col("kind") == "trap", F.col("found") == 0).otherwise(F.col("found") > 0) & F.col("error").isNull()
    seconds = F.when(F.col("error").isNull(), F.col("seconds"))
    total = runs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("ok"), F.max(seconds).alias("most"), F.sum(seconds).alias("total"))
    return total.join(medians(runs.where("error is null"), "kind", "seconds"), "kind", "left")


def message_kind(note: Column) -> Column:
    """Fixed prefixes of the expectation note."""
    upper = F.upper(F.trim(F.coalesce(note, F.lit(""))))
    return F.when(F.startswith(upper, F.lit("ПАСТКА")), "trap").when(F.startswith(upper, F.lit("ІНДИВІДУАЛЬНА")), "individual").otherwise("announcement")


def gate() -> Column:
    """Why an event is filtered before hashes are looked at, or null: the gates in order."""
    return F.when(~F.col("is_candidate"), "filtered").when(F.col("is_foreign"), "language").when(F.col("is_individual"), "individual").when(F.col("is_stale"), "stale")


def destinies(events: DataFrame) -> DataFrame:
    """``fate`` and ``feed``: the gates in order, then the first surviving event of each content hash.

    ``events`` has index, ordinal, date, content_hash, and booleans is_candidate, is_foreign,
    is_individual, is_stale. A filtered event doesn't occupy a hash.
    """
    gated = events.withColumn("__gate", gate())
    # The first of a hash by a minimum, map-side, and a join on the row's own keys: a common hash is no hot key.
    first = gated.where("__gate is null").groupBy("content_hash").agg(F.min(F.struct("index", "ordinal")).alias("__f"))
    first = first.select("content_hash", "__f.index", "__f.ordinal", F.lit(True).alias("__first"))
    fate = F.coalesce("__gate", F.when(F.col("__first"), "saved").otherwise("duplicate"))
    marked = gated.join(first, ["content_hash", "index", "ordinal"], "left").withColumn("fate", fate).drop("__gate", "__first")
    return marked.withColumn("feed", F.when(F.col("fate") == "saved", F.when(F.col("date").isNull(), "no_date").otherwise("feed")))


def summarize_destinies(events: DataFrame) -> DataFrame:
    return events.agg(*(F.count_if(F.col("fate") == f).alias(f) for f in FATES), F.count_if(F.col("feed") == "feed").alias("feed"))


def consensus_cells(answers: DataFrame) -> DataFrame:
    """(message_id, gi, field, answer, models): two or more models give one wrong answer.

    ``answers`` has model, message_id, gi, field, category and the normal form of the answer.
    """
    wrong = answers.where(F.col("category").isin("wrong", "fabricated"))
    return wrong.groupBy("message_id", "gi", "field", "answer").agg(F.count_distinct("model").alias("models")).where("models >= 2")


def pivot_answers(runs: DataFrame, models: list[str]) -> DataFrame:
    """A row a message, a column a model; without an answer a dash."""
    wide = runs.groupBy("message_id").pivot("model", models).agg(F.first("answer"))
    return wide.fillna("—", models)


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """``both`` counts as yes and as no."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("graded"), F.count_if(F.col("send").isin("yes", "both")).alias("yes"), F.count_if(F.col("send").isin("no", "both")).alias("no"),
        F.count_if("flagged").alias("flagged"),
    )


def flag_precision(auto: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """One row: automatic flags, those that people share, and each side's own."""
    both = auto.select(key).distinct().withColumn("a", F.lit(1)).join(human.select(key).distinct().withColumn("h", F.lit(1)), key, "full")
    a, h = F.col("a").isNotNull(), F.col("h").isNotNull()
    return both.agg(F.count_if(a).alias("auto"), F.count_if(a & h).alias("both"), F.count_if(h & ~a).alias("only_human"), F.count_if(a & ~h).alias("only_auto"))


def language_histogram(messages: DataFrame, language: str = "lang") -> DataFrame:
    return messages.groupBy(language).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), language)


def merge_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or touching (start, end) spans of a group as one: gaps and islands."""
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    island = F.sum("__new").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("__new", apart).withColumn("__island", island)
    return marked.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")
