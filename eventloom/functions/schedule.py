"""Repair of times and dates by what a message says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.rules import EXPLICIT_DATE_PATTERN

# Stems, shifts and number words, in the order in which they are tried.
WEEKDAYS = [
    ("понеділ", 0), ("вівтор", 1), ("серед", 2), ("четвер", 3),
    ("п'ятниц", 4), ("пʼятниц", 4), ("суббот", 5), ("субот", 5), ("неділ", 6),
]
SHIFTS = [("позавчора", -2), ("післязавтра", 2), ("вчора", -1), ("завтра", 1), ("сьогодні", 0)]
NUMBER_WORDS = {"один": 1, "два": 2, "три": 3, "чотири": 4, "п'ять": 5, "шість": 6, "сім": 7}
IN_N_PATTERN = r"через\s+(\d{1,2}|один|два|три|чотири|п'ять|шість|сім)?\s*(день|дні|днів|тиждень|тижні|тижнів)"
NEXT_WEEK_PATTERN = r"наступн\w*\s+(?:тижн\w*\s+)?$"


def _clock(hour: Column, minute: Column) -> Column:
    h, m = hour.try_cast("int"), minute.try_cast("int")
    return F.when((h <= 23) & (m <= 59), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))


def normalize_time(value: Column) -> Column:
    """``HH:MM`` or the start of a range; else null."""
    raw = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    span, exact = r"^(\d{1,2})[:.](\d{2})\s*[-–—]\s*\d{1,2}[:.]\d{2}$", r"^(\d{1,2}):(\d{2})$"
    return F.when(raw.rlike(span), _clock(F.regexp_extract(raw, span, 1), F.regexp_extract(raw, span, 2))).when(
        raw.rlike(exact), _clock(F.regexp_extract(raw, exact, 1), F.regexp_extract(raw, exact, 2))
    )


def next_weekday(reference: Column, weekday: int) -> Column:
    """The next such day (Monday is 0) strictly after the reference."""
    ahead = F.pmod(F.lit(weekday) - F.weekday(reference), F.lit(7))
    return F.date_add(reference, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))


def resolve_relative_date(text: Column, reference: Column) -> Column:
    """The date that words like tomorrow, in two weeks or on Friday name; null if none, or if they name past and future."""
    lowered = F.lower(text)
    said = {word: lowered.rlike(rf"(?U)\b{word}\b") for word, _ in SHIFTS}
    unclear = (said["вчора"] | said["позавчора"]) & (said["завтра"] | said["післязавтра"])
    shifted = [F.when(said[word], F.date_add(reference, n)) for word, n in SHIFTS]
    pattern = f"(?U){IN_N_PATTERN}"
    number, unit = F.regexp_extract(lowered, pattern, 1), F.regexp_extract(lowered, pattern, 2)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    count = F.coalesce(words[number], number.try_cast("int"), F.lit(1))
    in_n = F.when(unit != "", F.date_add(reference, (count * F.when(unit.rlike("^тиж[дн]"), 7).otherwise(1)).cast("int")))
    days = []
    for stem, weekday in WEEKDAYS:
        at = F.instr(lowered, stem)
        before = F.substring(lowered, F.lit(1), at - 1)
        later = F.when(before.rlike(f"(?U){NEXT_WEEK_PATTERN}"), 7).otherwise(0)
        days.append(F.when(at > 0, F.date_add(next_weekday(reference, weekday), later)))
    return F.when(~unclear, F.coalesce(*shifted, in_n, *days))


def has_explicit_date(text: Column) -> Column:
    return text.rlike(f"(?iU){EXPLICIT_DATE_PATTERN}")


def normalize_date(date: Column, text: Column, reference: Column) -> Column:
    """A date named in the text stands; without one, what the text says relatively."""
    return F.when(has_explicit_date(text), date).otherwise(F.coalesce(resolve_relative_date(text, reference), date))


def event_start(date: Column, time: Column) -> Column:
    """When an event starts; a bad or missing time is midnight, a missing date null."""
    good = F.trim(F.coalesce(time, F.lit(""))).rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    clock = F.when(good, F.trim(time)).otherwise("00:00")
    seconds = F.split(clock, ":")[0].try_cast("int") * 3600 + F.split(clock, ":")[1].try_cast("int") * 60
    return F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + seconds).cast("timestamp_ntz")


def normalize_clock(value: Column) -> Column:
    """The first ``H:MM`` or ``H.MM`` anywhere, as ``HH:MM``; out of range is null."""
    pattern = r"(?U)\b(\d{1,2})[:.](\d{2})\b"
    return F.when(value.rlike(pattern), _clock(F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)))
