"""Checks of a gold set: phrases of dates resolved by its own rules, and what contradicts the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.schedule import next_weekday
from eventloom.functions.text import each_normal, flat, keys_ok, norm

# Month names, the forms of weekdays that phrases take, shifts in days.
MONTHS = ["січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"]
ON_WEEKDAY = ["понеділок", "вівторок", "середу", "четвер", "п'ятницю", "суботу", "неділю"]
OF_WEEKDAY = ["понеділка", "вівторка", "середи", "четверга", "п'ятниці", "суботи"]
STEMS = ["понеділ", "вівтор", "серед", "четвер", "п'ятниц", "субот", "неділ"]
SHIFTS = {"сьогодні": 0, "завтра": 1, "післязавтра": 2, "через три дні": 3, "через тиждень": 7, "через два тижні": 14}
EVENT_TYPES = ["conference", "lecture", "webinar", "seminar", "workshop", "hackathon", "deadline", "exam", "consultation", "other"]
_MONTH = "(" + "|".join(MONTHS) + ")"
_TIME = r"(?U)\b(?:[01]?\d|2[0-3]):[0-5]\d\b|(?:\bоб?|\bз|\bдо)\s+(?:[01]?\d|2[0-3])\.[0-5]\d\b"
_URL = r"(?U)(https?://\S+?)(?=[\s,;)]|\.(?:\s|$)|$)"
# A number after these words is a time of day.
_BEFORE_TIME = r"(?<!(?:\bоб|\bо|\bз|\bдо)\s{1,5})"
_EXPLICIT = rf"(?U)(\b\d{{1,2}}(?:\s*[-–]\s*\d{{1,2}})?\s+(?:{'|'.join(MONTHS)})\b|{_BEFORE_TIME}\b\d{{1,2}}\.(?:0[1-9]|1[0-2])(?:\.\d{{4}})?\b)"


def explicit_dates(text: Column) -> Column:
    """Dates that a text names: with a month, or in digits unless they are a time or no month."""
    return F.regexp_extract_all(text, F.lit(_EXPLICIT), F.lit(1))


def _index(word: Column, words: list[str]) -> Column:
    """From 0; null for none of them."""
    at = F.array_position(F.array(*map(F.lit, words)), word)
    return F.when(at > 0, (at - 1).cast("int"))


def with_year(reference: Column, day: Column, month: Column, year: Column | None = None) -> Column:
    """The date; without a year the nearest that is not past. Null if there is no such day."""
    day, month = day.try_cast("int"), month.try_cast("int")
    made = lambda y: F.try_make_date(y, month, day) if hasattr(F, "try_make_date") else F.format_string("%04d-%02d-%02d", y, month, day).try_cast("date")
    soon = made(F.year(reference))
    near = F.when(soon >= reference, soon).when(soon.isNotNull(), made(F.year(reference) + 1))
    return near if year is None else F.when(year != "", made(year.try_cast("int"))).otherwise(near)


def resolve_phrase(phrase: Column, reference: Column) -> Column:
    """struct(date, inferred) of a date phrase; null where it has none of the known shapes or contradicts its weekday."""
    p = F.lower(F.trim(phrase))
    part = lambda pattern, k: F.regexp_extract(p, f"(?U)^{pattern}$", k)
    month = lambda pattern, k: _index(part(pattern, k), MONTHS) + 1
    told = lambda date, inferred: F.when(date.isNotNull(), F.struct(date.alias("date"), F.lit(inferred).alias("inferred")))
    relative = [F.when(p == w, F.date_add(reference, n)) for w, n in SHIFTS.items()]
    for i, w in enumerate(OF_WEEKDAY):
        ending = "ої" if i in (2, 4, 5) else "ого"
        this, near = ("цієї" if ending == "ої" else "цього"), ("найближчу" if i in (2, 4, 5) else "найближчий")
        day = next_weekday(reference, i)
        relative.append(F.when(p.isin(f"{this} {w}", f"у {near} {ON_WEEKDAY[i]}"), day))
        relative.append(F.when(p == f"наступн{ending} {w}", F.date_add(day, 7)))
    relative += [F.when(p == f"у {w}", next_weekday(reference, i)) for i, w in enumerate(ON_WEEKDAY)]
    on_day = rf"у (\S+), (\d{{1,2}}) {_MONTH}"
    named = with_year(reference, part(on_day, 2), month(on_day, 3))
    full, digits = rf"(\d{{1,2}}) {_MONTH} (\d{{4}}) року", r"(\d{1,2})\.(\d{2})(?:\.(\d{4}))?"
    span, over, plain = rf"(?:з )?(\d{{1,2}})(?:–| по )(\d{{1,2}}) {_MONTH}", rf"з (\d{{1,2}}) {_MONTH} по (\d{{1,2}}) {_MONTH}", rf"(\d{{1,2}}) {_MONTH}"
    said = [
        F.when(F.weekday(named) == _index(part(on_day, 1), ON_WEEKDAY), named),
        with_year(reference, part(full, 1), month(full, 2), part(full, 3)), with_year(reference, part(digits, 1), part(digits, 2), part(digits, 3)),
        with_year(reference, part(span, 1), month(span, 3)), with_year(reference, part(over, 1), month(over, 2)), with_year(reference, part(plain, 1), month(plain, 2)),
    ]
    return F.coalesce(told(F.coalesce(*relative), True), told(F.coalesce(*said), False))


def message_errors(gold: DataFrame) -> DataFrame:
    """(message_id, rule, event): what contradicts the rules of a gold set; ``event`` is the number of an event, or null.

    ``gold`` is as ``load_gold`` gives it. Events are held against their message inside its row.
    """
    text, ref = F.col("text"), F.col("date").cast("date")
    gold = gold.withColumns({"__n": norm(text), "__flat": flat(text)})
    lower = F.lower(text)
    note = F.coalesce("expect", F.lit(""))
    trap, announcement = F.col("kind") == "trap", F.col("kind") == "announcement"
    prefix = F.when(trap, "ПАСТКА").when(F.col("kind") == "individual", "ІНДИВІДУАЛЬНА")
    urls = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_URL), F.lit(1))))
    links = F.array_sort(F.array_distinct(F.filter(F.transform("events", lambda e: e["link"]["value"]), lambda v: v.isNotNull())))
    dated = rf"(?iU)\b((?:{'|'.join(STEMS)})\w*)\s*,?\s+(\d{{1,2}})\s+{_MONTH}\b"
    weekdays, days, months = (F.regexp_extract_all(lower, F.lit(dated), F.lit(k)) for k in (1, 2, 3))

    def other_day(x: Column) -> Column:
        date = with_year(ref, x["d"], _index(x["m"], MONTHS) + 1)
        stem = F.coalesce(*(F.when(F.startswith(x["w"], F.lit(s)), F.lit(i)) for i, s in enumerate(STEMS)))
        return F.coalesce(F.weekday(date) != stem, F.lit(True))

    pairs = F.arrays_zip(weekdays.alias("w"), days.alias("d"), months.alias("m"))
    whole = {
        "short_text": F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) < 50, "russian_letters": text.rlike("(?iu)[ыэъё]"),
        "note_prefix": prefix.isNotNull() & ~F.startswith(note, prefix), "note_of_announcement": announcement & note.rlike("^(ПАСТКА|ІНДИВІДУАЛЬНА)"),
        "weekday_of_date": F.exists(pairs, other_day), "trap_with_events": trap & (F.size("events") > 0), "no_events": ~trap & (F.size("events") == 0),
        "explicit_date": ~trap & F.forall("events", lambda e: F.coalesce(e["date"]["inferred"], F.lit(False))) & (F.size(explicit_dates(text)) > 0),
        "time_in_text": ~trap & F.forall("events", lambda e: e["time"]["value"].isNull()) & text.rlike(_TIME), "links": ~trap & (urls != links),
        "reaches_db": ~trap & (F.col("reaches_db") != announcement),
    }
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = ["event_title", "location", "organizer", "target_audience"]
    # Keys are made normal as columns of the message's row, an array an event: lambdas can't call the Arrow function.
    events = gold.where(~trap).select("message_id", "__n", "__flat", text.alias("text"), ref.alias("ref"), F.posexplode("events").alias("event", "e"))
    has = lambda f: F.col(f"e.{f}.value").isNotNull()
    none = F.array().cast("array<array<string>>")
    keys = lambda f, form: each_normal(F.coalesce(F.col(f"e.{f}.keys"), none), form)
    solved = resolve_phrase(F.col("e.date.phrase"), F.col("ref"))
    date_phrase, time_phrase = F.lower(blank(F.col("e.date.phrase"))), F.lower(blank(F.col("e.time.phrase")))
    clock = F.concat(F.lpad(F.regexp_extract(time_phrase, r"(\d{1,2})[:.](\d{2})", 1), 2, "0"), F.lit(":"), F.regexp_extract(time_phrase, r"(\d{1,2})[:.](\d{2})", 2))
    each = {
        "event_type": ~blank(F.col("e.event_type.value")).isin(*EVENT_TYPES), "date_phrase": ~F.contains(F.lower("text"), date_phrase),
        "only_day_after": (date_phrase == "завтра") & ~F.lower("text").rlike("(?U)(?<!після)завтра"), "date_resolved": solved.isNull(),
        "date_value": solved.isNotNull() & (blank(F.col("e.date.value")) != solved["date"].cast("string")), "date_inferred": solved.isNotNull() & (solved["inferred"] != F.coalesce("e.date.inferred", F.lit(False))),
        "time_phrase": has("time") & ~F.contains(F.lower("text"), time_phrase), "time_value": has("time") & (clock != F.col("e.time.value")),
        **{f"keys_{f}": has(f) & ~keys_ok(keys(f, norm), F.col("__n")) for f in keyed}, "organizer_named": ~has("organizer") & F.contains("__n", F.lit("організатор")),
        "link_in_text": has("link") & ~F.contains("text", F.col("e.link.value")), "meeting_code": has("meeting_code") & ~keys_ok(keys("meeting_code", flat), F.col("__flat")),
        "language": blank(F.col("e.language.value")) != "uk",
    }
    listed = lambda rules: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())), lambda x: x.isNotNull())
    of_messages = gold.select("message_id", F.explode(listed(whole)).alias("rule"), F.lit(None).cast("int").alias("event"))
    return of_messages.unionByName(events.select("message_id", F.explode(listed(each)).alias("rule"), "event"))


def set_checks(gold: DataFrame) -> DataFrame:
    """One row: messages by kind, gold events, and whether ids and texts are unique."""
    return gold.agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("message_id") == F.count(F.lit(1))).alias("unique_ids"), (F.count_distinct("text") == F.count(F.lit(1))).alias("unique_texts"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("announcement", "trap", "individual")), F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("events"),
    )


def table_checks(messages: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row: messages, and how many different ids and texts they have; texts by a hash, so that no long one is sent on."""
    return messages.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row_id).alias("ids"), F.count_distinct(F.sha2(F.encode(text, "utf-8"), 256)).alias("texts"))
