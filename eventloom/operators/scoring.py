"""Scores of extracted events against gold data: alignment, field verdicts, counters, intervals.

Gold events are rows (message_id, gold_idx, the eleven fields, and where they have them
``<field>_keys``, ``event_type_accept`` and ``inferred``), predictions (message_id, pred_idx,
the fields); both are numbered from 0 in a message. Columns that are missing are null.

Gold and predicted events of a message meet in one row (a message holds a few events) as they
were given, so that a score costs one exchange of each side, or none where rows hold them
already; in that row normal forms are worked out, once a message, pairs are chosen and cells are
judged. Everything after that are sums over messages, which combine map-side; resamples draw
from blocks of messages and make no table of draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.schedule import normalize_clock
from eventloom.functions.text import is_empty, joined_groups, joined_lists, joined_values, joint_forms, keys_ok, split_groups, stripped

FIELDS = ["event_title", "date", "time", "location", "organizer", "target_audience", "event_type", "description", "language", "link", "meeting_code"]
#: Fields that are held against keys: each group of them must be met by one of its alternatives.
KEY_FIELDS = ["event_title", "location", "organizer", "target_audience"]
PAIR_THRESHOLD = 2
CATEGORIES = ["correct", "invented_ok", "wrong", "fabricated", "missed"]
STATUSES = ["paired", "missed_event", "extra_event", "false_event"]
CI_METRICS = ["field_accuracy_all", "fabrication_rate", "correct_reject_rate"]
RESAMPLES, RESAMPLING_SEED = 1000, 20260922
AMBIGUOUS_TAG, BOUNDARY_TAG = "ambiguous:next_weekday", "boundary"
LINK_ENDS = "/.,;)"


def _of(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normal_link(value: Column) -> Column:
    bare = F.rtrim(stripped(value), F.lit(LINK_ENDS))
    return F.when(bare != "", bare)


def _without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


#: Fields whose values and keys are made normal.
FORMS = [*KEY_FIELDS, "meeting_code"]
_KEYS = "array<array<string>>"


def once(value: Column) -> Column:
    """``value``, worked out once a row: the optimizer copies nothing into filters and later steps that isn't deterministic."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _form(field: str, text: Column) -> Column:
    return _without_blanks(text) if field == "meeting_code" else text


def gold_rows(gold: DataFrame) -> DataFrame:
    """(message_id, gold): the events of a message as they were given, by their number."""
    event = F.struct(
        F.col("gold_idx").cast("int").alias("gi"), *(_of(gold, f).alias(f) for f in FIELDS), *(F.col(f"{f}_keys").cast(_KEYS).alias(f"{f}_keys") for f in FORMS if f"{f}_keys" in gold.columns),
        _of(gold, "event_type_accept", "array<string>").alias("event_type_accept"), _of(gold, "inferred", "boolean").alias("inferred"),
    )
    events = gold.select("message_id", event.alias("e"))
    return events.groupBy("message_id").agg(F.sort_array(F.collect_list("e")).alias("gold"))


def predicted_rows(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(message_id, predicted), and ``by``, which tells runs apart: likewise."""
    events = predicted.select(*by, "message_id", F.struct(F.col("pred_idx").cast("int").alias("pi"), *(_of(predicted, f).alias(f) for f in FIELDS)).alias("e"))
    return events.groupBy(*by, "message_id").agg(F.sort_array(F.collect_list("e")).alias("predicted"))


def with_forms(df: DataFrame, runs: Sequence[str] = ("",)) -> DataFrame:
    """``gold`` and, for each run, ``predicted<run>`` with the normal forms of what is held against each other.

    All values and keys of a message are made normal as one text. Without keys the value is the
    only one; a predicted value of white space alone is none.
    """
    keyed = [f for f in FORMS if f"{f}_keys" in df.schema["gold"].dataType.elementType.fieldNames()]
    groups = lambda e, f: F.coalesce(e[f"{f}_keys"], F.array().cast(_KEYS))
    said = lambda e: {f: F.when(~is_empty(e[f]), e[f]) for f in FIELDS}
    lists = [F.transform("gold", lambda e: joined_values([*(e[f] for f in FORMS), *(joined_groups(groups(e, f)) for f in keyed)]))]
    lists += [F.transform(f"predicted{r}", lambda e: joined_values([said(e)[f] for f in FORMS])) for r in runs]
    df = df.withColumn("__text", joined_lists(lists)).withColumn("__forms", once(joint_forms(F.col("__text")))).drop("__text")

    def forms(n: int, i: Column, k: int) -> Column:
        return F.get(F.get(F.get("__forms", n), i), k)

    def keys(e: Column, i: Column, f: str) -> Column:
        value = F.array(F.array(_form(f, forms(0, i, FORMS.index(f)))))
        if f not in keyed:
            return value
        return F.when(F.size(groups(e, f)) > 0, split_groups(groups(e, f), _form(f, forms(0, i, len(FORMS) + keyed.index(f))))).otherwise(value)

    def gold_event(e: Column, i: Column) -> Column:
        return F.struct(
            e["gi"].alias("gi"), *(e[f].alias(f) for f in FIELDS), *(keys(e, i, f).alias(f"{f}_keys") for f in FORMS),
            F.coalesce(e["event_type_accept"], F.array().cast("array<string>")).alias("accept"), normal_link(e["link"]).alias("bare_link"), F.coalesce(e["inferred"], F.lit(False)).alias("inferred"),
        )

    def predicted_event(n: int):
        return lambda e, i: F.struct(
            e["pi"].alias("pi"), *(c.alias(f) for f, c in said(e).items()), *(_form(f, forms(n, i, k)).alias(f"n_{f}") for k, f in enumerate(FORMS)),
            normalize_clock(said(e)["time"]).alias("clock"), normal_link(said(e)["link"]).alias("bare_link"),
        )

    return df.withColumns({"gold": once(F.transform("gold", gold_event)), **{f"predicted{r}": once(F.transform(f"predicted{r}", predicted_event(n))) for n, r in enumerate(runs, 1)}}).drop("__forms")


def field_matches(field: str, g: Column, p: Column) -> Column:
    """Whether a value that was given counts as the gold one; ``g`` and ``p`` are events of ``gold_rows`` and ``predicted_rows``."""
    if field in KEY_FIELDS or field == "meeting_code":
        return keys_ok(g[f"{field}_keys"], p[f"n_{field}"])
    if field == "time":
        return p["clock"] == g["time"]
    if field == "link":
        return p["bare_link"].eqNullSafe(g["bare_link"])
    if field == "description":
        return F.lit(True)
    same = stripped(p[field]) == g[field]
    return same | F.array_contains(g["accept"], stripped(p[field])) if field == "event_type" else same


def _pair_score(g: Column, p: Column) -> Column:
    """3 for the date, 2 for the title, 1 for the time."""
    points = lambda field, n: F.when(F.coalesce(~is_empty(g[field]) & p[field].isNotNull() & field_matches(field, g, p), F.lit(False)), n).otherwise(0)
    title = F.when(p["event_title"].isNotNull() & field_matches("event_title", g, p), 2).otherwise(0)
    return points("date", 3) + title + points("time", 1)


def field_category(gold: Column, said: Column, matches: Column, inferred: Column | None = None) -> Column:
    good = F.lit("correct") if inferred is None else F.when(inferred, "invented_ok").otherwise("correct")
    return (
        F.when(gold.isNull() & ~said, "correct").when(gold.isNull(), "fabricated").when(~said, "missed")
        .when(F.coalesce(matches, F.lit(False)), good).otherwise("wrong")
    )


def scored(messages: DataFrame, gold: DataFrame, predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``judged`` of one row a message (and run, which ``by`` tells apart in messages and predictions), with its columns."""
    g_rows, p_rows = gold_rows(gold), predicted_rows(predicted, by)
    return judged(messages.join(g_rows, "message_id", "left").join(p_rows, [*by, "message_id"], "left"))


def judged(df: DataFrame, runs: Sequence[str] = ("",)) -> DataFrame:
    """Rows of a message with its ``gold`` and ``predicted`` events, as in ``gold_rows`` and ``predicted_rows``, and in addition
    ``candidates`` (s, gi, pi; s is the negative score), ``pairs`` (gi, pi, score) and ``cells`` (gi, pi, field, category,
    gold_null, gold_value, said). All but ``gold`` once for each of ``runs``, which are the ends of these columns' names.

    Nothing is exchanged. Pairs are chosen greedily, the best first, ties by gold and then by prediction: a total
    order, so a fold over the sorted candidates decides. Fields are judged for each pair.
    """
    kinds = dict(df.dtypes)
    df = df.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("gold", *(f"predicted{r}" for r in runs))})
    df = with_forms(df, runs)
    start = F.array().cast("array<struct<gi:int,pi:int,score:int>>")

    def step(acc: Column, c: Column) -> Column:
        used = F.exists(acc, lambda x: (x["gi"] == c["gi"]) | (x["pi"] == c["pi"]))
        return F.when(used, acc).otherwise(F.array_append(acc, F.struct(c["gi"].alias("gi"), c["pi"].alias("pi"), (-c["s"]).cast("int").alias("score"))))

    def cells(x: Column) -> Column:
        out = []
        for f in FIELDS:
            verdict = field_category(x["g"][f], x["p"][f].isNotNull(), field_matches(f, x["g"], x["p"]), x["g"]["inferred"] if f == "date" else None)
            out.append(F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"), F.lit(f).alias("field"), verdict.alias("category"), x["g"][f].isNull().alias("gold_null"), x["g"][f].alias("gold_value"), x["p"][f].alias("said")))
        return F.array(*out)

    def pair(r: str):
        def of(x: Column) -> Column:
            g, p = F.filter("gold", lambda e: e["gi"] == x["gi"])[0], F.filter(f"predicted{r}", lambda e: e["pi"] == x["pi"])[0]
            return F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"), g.alias("g"), p.alias("p"))

        return of

    def met(r: str) -> Column:
        each = F.transform("gold", lambda g: F.transform(f"predicted{r}", lambda p: F.struct((-_pair_score(g, p)).alias("s"), g["gi"].alias("gi"), p["pi"].alias("pi"))))
        return F.sort_array(F.filter(F.flatten(each), lambda c: c["s"] <= -PAIR_THRESHOLD))

    df = df.withColumns({f"candidates{r}": once(met(r)) for r in runs})
    df = df.withColumns({f"pairs{r}": once(F.sort_array(F.aggregate(f"candidates{r}", start, step))) for r in runs})
    df = df.withColumns({f"__met{r}": F.transform(f"pairs{r}", pair(r)) for r in runs})
    return df.withColumns({f"cells{r}": once(F.flatten(F.transform(f"__met{r}", cells))) for r in runs}).drop(*(f"__met{r}" for r in runs))


def candidates(scores: DataFrame) -> DataFrame:
    """(message_id, gi, pi, score) of pairs in one message that reach the threshold."""
    each = scores.select("message_id", F.explode("candidates").alias("x"))
    return each.select("message_id", "x.gi", "x.pi", (-F.col("x.s")).alias("score"))


def align(scores: DataFrame) -> DataFrame:
    """(message_id, gi, pi, score) of the chosen pairs."""
    return scores.select("message_id", F.explode("pairs").alias("x")).select("message_id", "x.*")


def field_scores(scores: DataFrame) -> DataFrame:
    """(message_id, gi, field, category, gold_null): a row for each field of each pair."""
    return scores.select("message_id", F.explode("cells").alias("x")).select("message_id", "x.gi", "x.field", "x.category", "x.gold_null")


def _lost(scores_of: str = "gold") -> Column:
    return F.filter(scores_of, lambda g: ~F.exists("pairs", lambda x: x["gi"] == g["gi"]))


def alignment_rows(scores: DataFrame) -> DataFrame:
    """(message_id, kind, status, gi, pi, score, gold_title, pred_title): pairs, then what has no partner; of a
    trap a prediction is a false event, else an extra one."""
    nul = F.lit(None).cast("int")
    title_of = lambda rows, key, value, f: F.filter(rows, lambda e: e[key] == value)[0][f]
    row = lambda status, gi, pi, score, a, b: F.struct(
        status.alias("status"), gi.alias("gi"), pi.alias("pi"), score.alias("score"), a.alias("gold_title"), b.alias("pred_title")
    )
    blank, none = F.lit(""), F.lit(0)
    paired = F.transform("pairs", lambda x: row(F.lit("paired"), x["gi"], x["pi"], x["score"], F.coalesce(title_of("gold", "gi", x["gi"], "event_title"), blank), F.coalesce(title_of("predicted", "pi", x["pi"], "event_title"), blank)))
    missed = F.transform(_lost(), lambda g: row(F.lit("missed_event"), g["gi"], nul, none, F.coalesce(g["event_title"], blank), blank))
    alone = F.filter("predicted", lambda p: ~F.exists("pairs", lambda x: x["pi"] == p["pi"]))
    status = F.when(F.col("kind") == "trap", "false_event").otherwise("extra_event")
    extra = F.transform(alone, lambda p: row(status, nul, p["pi"], none, blank, F.coalesce(p["event_title"], blank)))
    each = scores.select("message_id", "kind", F.explode(F.concat(paired, missed, extra)).alias("x"))
    return each.select("message_id", "kind", "x.*")


def field_rows(scores: DataFrame) -> DataFrame:
    """(message_id, kind, gold_event, field, field_category, gold_value, predicted_value): the cells of pairs, and a
    missed cell for every field of an event that was not found."""
    blank = F.lit("")
    value = lambda c: F.coalesce(F.when((c["field"] == "description") & ~c["gold_null"], "є деталі").otherwise(c["gold_value"]), blank)
    row = lambda gi, field, category, a, b: F.struct(gi.alias("gold_event"), field.alias("field"), category.alias("field_category"), a.alias("gold_value"), b.alias("predicted_value"))
    met = F.transform("cells", lambda c: row(c["gi"], c["field"], c["category"], value(c), F.coalesce(c["said"], blank)))
    lost = F.flatten(F.transform(_lost(), lambda g: F.array(*(row(g["gi"], F.lit(f), F.lit("missed"), blank, blank) for f in FIELDS))))
    return scores.select("message_id", "kind", F.explode(F.concat(met, lost)).alias("x")).select("message_id", "kind", "x.*")


def sliced(counters: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """``summed`` of several slices, a row each, over one pass: ``slice``, and the sums where its condition holds."""
    names = counter_names(counters)
    total = counters.agg(*(F.struct(F.lit(name).alias("slice"), *(F.sum(F.when(cond, F.col(c))).alias(c) for c in names)).alias(name) for name, cond in slices.items()))
    return total.select(F.explode(F.array(*slices)).alias("x")).select("x.*")


def message_counters(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a message (and run) of additive counters. Sums of them are the total's.

    ``scores`` may have ``error`` (the extraction failed: it counts, and a silent trap isn't clean)
    and ``kept`` (events that outlast the filters).
    """
    said, trap, alone = (F.col("kind") == k for k in ("announcement", "trap", "individual"))
    n_gold, n_pred, n_pair = F.size("gold"), F.size("predicted"), F.size("pairs")
    failed = _of(scores, "error").isNotNull()
    dropped = _of(scores, "kept", "int") == 0
    n_missed, n_extra, multi = n_gold - n_pair, n_pred - n_pair, said & (n_gold > 1)
    n_of = lambda test: F.size(F.filter("cells", test))
    n_in = lambda category: n_of(lambda x: x["category"] == category)
    only = lambda cond, value=1: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0).cast("long")
    n = len(FIELDS)
    counts = {
        **{c: only(said, n_in(c)) for c in CATEGORIES},
        "correct_null": only(said, n_of(lambda x: (x["category"] == "correct") & x["gold_null"])),
        "paired_fields": only(said, F.size("cells")), "paired_gold_null": only(said, n_of(lambda x: x["gold_null"])), "paired_gold_nonnull": only(said, n_of(lambda x: ~x["gold_null"])),
        "missed_event_fields": only(said, n_missed * n), "gold_fields_total": only(said, n_gold * n),
        "announcements": only(said), "announcements_detected": only(said & (n_pair > 0)),
        "traps": only(trap), "traps_clean": only(trap & (n_pred == 0) & ~failed), "trap_false_events": only(trap, n_pred),
        "individual": only(alone), "individual_extracted": only(alone & (n_pred > 0)), "individual_dropped": only(alone & (n_pred > 0) & dropped),
        "multi": only(multi), "multi_all_paired": only(multi & (n_missed == 0)), "multi_merged": only(multi & (n_pred < n_gold) & (n_pred > 0) & (n_extra == 0)),
        "extra_events": only(said, n_extra), "missed_events": only(said, n_missed), "errors": only(failed), "messages": F.lit(1).cast("long"),
    }
    return scores.select(*by, "message_id", "kind", *(c.alias(k) for k, c in counts.items()))


def counter_names(counters: DataFrame, by: Sequence[str] = ()) -> list[str]:
    return [c for c, kind in counters.dtypes if kind == "bigint" and c not in ("message_id", *by)]


def summed(counters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counters.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counter_names(counters, by)))


def metrics(total: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rates of summed counters; null where there is nothing to divide by."""
    good = F.col("correct") + F.col("invented_ok")
    rate = lambda a, b: F.try_divide(a.cast("double"), F.col(b))
    return total.select(
        *keep, rate(good, "gold_fields_total").alias("field_accuracy_all"), rate(good, "paired_fields").alias("field_accuracy_paired"),
        rate(F.col("fabricated"), "paired_gold_null").alias("fabrication_rate"), rate(F.col("wrong"), "paired_gold_nonnull").alias("wrong_rate"),
        rate(F.col("missed"), "paired_gold_nonnull").alias("omission_rate"), (F.col("wrong") + F.col("fabricated")).alias("invented_bad"),
        rate(F.col("announcements_detected"), "announcements").alias("detection_rate"), rate(F.col("traps_clean"), "traps").alias("correct_reject_rate"),
    )


def per_field_errors(scores: DataFrame) -> DataFrame:
    """One row a field, over announcements: verdicts of the pairs; a missed event adds a miss to every field."""
    lost = F.transform(_lost(), lambda g: F.array(*(F.struct(F.lit(f).alias("field"), F.lit("missed").alias("category"), F.lit(False).alias("gold_null")) for f in FIELDS)))
    met = F.transform("cells", lambda c: F.struct(c["field"].alias("field"), c["category"].alias("category"), c["gold_null"].alias("gold_null")))
    every = scores.where("kind = 'announcement'").select(F.explode(F.concat(met, F.flatten(lost))).alias("x")).select("x.*")
    return every.groupBy("field").agg(
        *(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES),
        F.count_if((F.col("category") == "correct") & F.col("gold_null")).alias("correct_null"), F.count(F.lit(1)).alias("total"),
    )


def trap_breakdown(counters: DataFrame, subtype: Column, boundary: Column | None = None) -> DataFrame:
    """Traps by their subtype: how many are clean, how many false events, how many on the boundary."""
    traps = counters.where("kind = 'trap'").withColumn("__b", F.lit(False) if boundary is None else boundary)
    return traps.groupBy(subtype.alias("subtype")).agg(
        F.count(F.lit(1)).alias("traps"), F.sum("traps_clean").alias("clean"), F.sum("trap_false_events").alias("false_events"), F.count_if("__b").alias("boundary")
    )


def subtype(category: Column) -> Column:
    """What stands behind the first colon, else the whole."""
    return F.when(F.contains(category, F.lit(":")), F.substring(category, F.instr(category, ":") + 1, F.length(category))).otherwise(category)


#: Messages of a block, roughly: what a task draws from at once.
DRAWN_BLOCK = 8192
#: Draws that are made at once.
_DRAWN_AT_ONCE = 1 << 20
_WIDE, _ID, _DRAW, _TURN, _BLOCK_STEP = 1 << 32, 1_000_000_007, 2_654_435_761, 40_503, 3_266_489_917


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers, in integers that every engine has."""
    for _ in range(2):
        x = (x ^ (x >> 16)) * 73_244_475 % _WIDE
    return x ^ (x >> 16)


def _mixed_column(x: Column) -> Column:
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * 73_244_475, F.lit(_WIDE))
    return x.bitwiseXOR(F.shiftright(x, 16))


def drawn_block(message_id: Column, blocks: int, seed: int = RESAMPLING_SEED) -> Column:
    """The block of a message, by a hash."""
    return (_mixed_column((F.pmod(message_id, F.lit(_ID)) * _DRAW + seed) % _WIDE) % blocks).cast("long")


def draws_of_blocks(spark: SparkSession, sizes: Sequence[int], resamples: int, seed: int = RESAMPLING_SEED) -> DataFrame:
    """(draw, block, times): how many of a resample's draws fall to each block: as many in all as there are messages.

    Draw i of a resample takes a place among all messages by a hash of both; the block is the one
    that has the place. Resamples are shared out to tasks, which send on a number a block.
    """
    ends = np.cumsum(np.array(sizes, np.int64))
    n = int(ends[-1]) if len(ends) else 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for draw in part["id"].tolist():
                times = np.zeros(len(ends), np.int64)
                for low in range(0, n, _DRAWN_AT_ONCE):
                    turns = np.arange(low, min(n, low + _DRAWN_AT_ONCE), dtype=np.int64)
                    places = _mixed((draw * _DRAW + turns * _TURN + seed) % _WIDE) % n
                    times += np.bincount(np.searchsorted(ends, places, "right"), minlength=len(ends))
                yield pd.DataFrame({"draw": draw, "block": np.arange(len(ends)), "times": times})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, resamples, 1, min(resamples, tasks)).mapInPandas(count, "draw long, block long, times long")


def resampled(counters: DataFrame, resamples: int = RESAMPLES, seed: int = RESAMPLING_SEED, block: int = DRAWN_BLOCK) -> DataFrame:
    """Counters summed for each resample: as many messages as there are (not fields), drawn with replacement.

    Messages stand in blocks of bounded size. It is drawn first how many draws of each resample
    fall to a block (multinomial numbers, ``draws_of_blocks``), then, block by block, which messages
    they take: a task has the counters of one block and adds up all resamples of it. No table of draws is made.
    """
    names = counter_names(counters)
    n = counters.count()
    blocks = max(1, -(-n // block))
    placed = counters.select("message_id", drawn_block(F.col("message_id"), blocks, seed).alias("block"), *names)
    found = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}
    draws = draws_of_blocks(counters.sparkSession, [found.get(k, 0) for k in range(blocks)], resamples, seed)

    def draw(messages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(messages):
            return pd.DataFrame({"draw": [], **{c: [] for c in names}}).astype("int64")
        values = messages.sort_values("message_id")[names].to_numpy(np.int64)
        k, size, sums = int(messages["block"].iloc[0]), len(values), np.zeros((len(asked), len(names)), np.int64)
        for row, (d, times) in enumerate(zip(asked["draw"].tolist(), asked["times"].tolist(), strict=True)):
            turns = np.arange(times, dtype=np.int64)
            places = _mixed((d * _DRAW + turns * _TURN + k * _BLOCK_STEP + seed + 1) % _WIDE) % size
            sums[row] = np.bincount(places, minlength=size) @ values
        return pd.DataFrame(sums, columns=names).assign(draw=asked["draw"].to_numpy())

    schema = ", ".join(["draw long", *(f"{c} long" for c in names)])
    each = placed.groupBy("block").cogroup(draws.groupBy("block")).applyInPandas(lambda m, a: draw(m, a)[["draw", *names]], schema)
    return each.groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))


_RATED = ["correct", "invented_ok", "wrong", "fabricated", "missed", "gold_fields_total", "paired_fields", "paired_gold_null", "paired_gold_nonnull", "announcements", "announcements_detected", "traps", "traps_clean"]


def bootstrap_intervals(counters: DataFrame, names: Sequence[str] = CI_METRICS, resamples: int = RESAMPLES, seed: int = RESAMPLING_SEED) -> DataFrame:
    """(metric, low, high): 95% percentile intervals over messages; null draws are left out."""
    rates = metrics(resampled(counters.select("message_id", *_RATED), resamples, seed), ["draw"])
    long = rates.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names))).alias("x")).select("x.*")
    return long.where("v is not null").groupBy("metric").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def paired_difference(left: DataFrame, right: DataFrame, metric: str = "field_accuracy_all", resamples: int = RESAMPLES, seed: int = RESAMPLING_SEED) -> DataFrame:
    """(observed, low, high) of the difference of a metric, on the same draws of common messages.

    Without a draw in which both have a value the interval is the observed difference.
    """
    both = left.select("message_id", *(F.col(c).alias(f"a_{c}") for c in _RATED)).join(right.select("message_id", *(F.col(c).alias(f"b_{c}") for c in _RATED)), "message_id")
    side = lambda t, k, keep: metrics(t.select(*keep, *(F.col(f"{k}_{c}").alias(c) for c in _RATED)), keep).select(*keep, F.col(metric).alias(k))
    drawn = resampled(both, resamples, seed)
    # A row a draw, and one row of all.
    each = side(drawn, "a", ["draw"]).join(side(drawn, "b", ["draw"]), "draw").select((F.col("a") - F.col("b")).alias("d"))
    interval = each.where("d is not null").agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    total = both.agg(*(F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k in "ab" for c in _RATED)).withColumn("one", F.lit(1))
    observed = side(total, "a", ["one"]).join(side(total, "b", ["one"]), "one").select((F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("observed"), "one")
    out = observed.join(F.broadcast(interval.withColumn("one", F.lit(1))), "one")
    return out.select("observed", F.coalesce("low", "observed").alias("low"), F.coalesce("high", "observed").alias("high"))


def unambiguous() -> Column:
    """Not of messages whose next weekday can be read in two ways."""
    return ~F.coalesce(F.array_contains("tags", AMBIGUOUS_TAG), F.lit(False))


def inside_boundary() -> Column:
    """Not of traps that are traps by a convention."""
    return ~F.coalesce(F.array_contains("tags", BOUNDARY_TAG), F.lit(False))


def without_ambiguous(scores: DataFrame) -> DataFrame:
    return scores.where(unambiguous())


def without_boundary(scores: DataFrame) -> DataFrame:
    return scores.where(inside_boundary())


def halves_gap(counters: DataFrame, half: Column, flag_above: float = 0.05) -> DataFrame:
    rates = metrics(summed(counters.withColumn("half", half), ["half"]), ["half"])
    gap = F.max("field_accuracy_all") - F.min("field_accuracy_all")
    return rates.agg(gap.alias("gap")).withColumn("unstable", F.col("gap") > flag_above)
