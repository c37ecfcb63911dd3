"""Literal cases of single rules, and a hand-computed score."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions import grounding, meeting, schedule
from eventloom.functions import text as texts
from eventloom.operators import feed, reports, review, scoring


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'string'}" for k, v in cells.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said, source, status", [
    (None, "будь-що", "empty"), ("корпус 3", "у аудиторії третього корпусу", "ok"), ("аудиторія 405", "в ауд. 406", "invented"),
    ("відкриття виставки", "відкриття завтра", "suspect"), ("відкриття виставки", "откроется выставка", "invented"), ("семінар", "лекція", "invented"), ("12", "о 12 годині", "ok"), ("та", "текст", "suspect"),
])
def test_text_status(spark, said, source, status):
    assert value(spark, grounding.text_status(F.col("v"), F.col("s")), v=said, s=source) == status


@pytest.mark.parametrize("said, source, status", [
    ("14:30", "о 14:30", "ok"), ("14:45", "о 14:30", "suspect"), ("14:00", "о 14 год", "suspect"), ("25:00", "о 14:30", "invalid"), ("09:00", "о 14:30", "invented"), (None, "", "empty"),
])
def test_time_status(spark, said, source, status):
    assert value(spark, grounding.time_status(F.col("v"), F.col("s")), v=said, s=source) == status


def test_codes_links_languages(spark):
    assert value(spark, grounding.code_status(F.col("v"), F.col("s")), v="ID 8452371", s="id 845 2371") == "ok"
    assert value(spark, grounding.code_status(F.col("v"), F.col("s")), v="код 99", s="id 845 2371") == "invented"
    assert value(spark, grounding.link_status(F.col("v"), F.col("s")), v=None, s="див. https://a.ua") == "missed"
    assert value(spark, grounding.language_status(F.col("v"), F.col("s")), v="uk", s="їжа") == "ok"
    assert value(spark, grounding.detect_script(F.col("s")), s="їы") == "ru"


def test_repairs(spark):
    text = "Зустріч онлайн у Zoom: https://z.us/j/1?p=2."
    assert value(spark, meeting.repaired_link(F.col("l"), F.col("t")), l="https://made.up/", t=text) == "https://z.us/j/1?p=2"
    assert value(spark, meeting.repaired_link(F.col("l"), F.col("t")), l="https://made.up/", t="без посилань") is None
    assert value(spark, meeting.repaired_location(F.col("l"), F.col("t")), l="https://z.us/j/1", t=text) == "Онлайн (Zoom)"
    assert value(spark, meeting.repaired_location(F.col("l"), F.col("t")), l="ауд. 5", t=text) == "ауд. 5"
    ref = dt.date(2026, 11, 2)
    assert value(spark, schedule.normalize_date(F.col("d"), F.col("t"), F.col("r")), d=dt.date(2026, 1, 1), t="15 жовтня, завтра", r=ref) == dt.date(2026, 1, 1)
    assert value(spark, schedule.normalize_date(F.col("d"), F.col("t"), F.col("r")), d=dt.date(2026, 1, 1), t="завтра", r=ref) == dt.date(2026, 11, 3)


def test_normal_forms(spark):
    for raw, want in (
        ("Аудиторія № 5,  2-го ’курсу’ – 7", "аудиторія no 5, 2 'курсу'-7"), ("П’ятниця", "п'ятниця"), ("Пʼятниця", "п'ятниця"), ("15–16 жовтня", "15-16 жовтня"), ("15 — 16 жовтня", "15-16 жовтня"),
        ("студенти 2-го курсу", "студенти 2 курсу"), ("  Багато   пробілів  ", "багато пробілів"), ("ауд. № 305", "ауд. no 305"), ("STRAẞE ﬁ Ⅷ", "strasse fi viii"),
    ):
        assert value(spark, texts.norm(F.col("v")), v=raw) == want
    assert value(spark, texts.flat(F.col("v")), v=" 958 70 ") == "95870"
    edited = value(spark, texts.parse_edit_lines(F.col("v"), {"назва": "event_title", "дата": "date"}), v="Назва: Лекція: вступ\nдата: -\nінше: x")
    assert edited == {"event_title": "Лекція: вступ", "date": None}


def _events(spark, index, rows):
    """Rows of (message_id, number, {field: value})."""
    fields = scoring.FIELDS
    return spark.createDataFrame([(m, n, *(e.get(f) for f in fields)) for m, n, e in rows], f"message_id long, {index} int, " + ", ".join(f"{f} string" for f in fields))


def _kinds(spark, *kinds):
    return spark.createDataFrame(list(enumerate(kinds, 1)), "message_id long, kind string")


def test_greedy_alignment_conflict(spark):
    day = "2024-01-01"
    gold = _events(spark, "gold_idx", [(1, 0, {"event_title": "a", "date": day, "time": "10:00"}), (1, 1, {"event_title": "b", "date": day, "time": "11:00"})])
    said = _events(spark, "pred_idx", [(1, 0, {"event_title": "b", "date": day, "time": "10:00"}), (1, 1, {"event_title": "a", "date": day})])
    scores = scoring.scored(_kinds(spark, "announcement"), gold, said)
    assert sorted((r.gi, r.pi, r.score) for r in scoring.align(scores).collect()) == [(0, 1, 5), (1, 0, 5)]


def test_counters_by_hand(spark):
    gold = _events(spark, "gold_idx", [(1, 0, {
        "event_title": "Відкрита лекція", "date": "2026-10-12", "time": "14:00", "location": "ауд. 305", "target_audience": "3 курс", "event_type": "lecture", "description": "true", "language": "uk",
    })])
    said = _events(spark, "pred_idx", [(1, 0, {
        "event_title": "Відкрита лекція з ML", "date": "2026-10-13", "time": "о 14.00", "location": "Ауд. 305", "organizer": "Кафедра ІТ", "target_audience": " ", "event_type": "lecture", "description": "x", "language": "uk",
    }), (2, 0, {"event_title": "x"})])
    scores = scoring.scored(_kinds(spark, "announcement", "trap", "individual", "trap"), gold, said)
    total = scoring.summed(scoring.message_counters(scores.withColumn("error", F.when(F.col("message_id") == 4, "unavailable"))))
    row = total.first().asDict()
    want = {"correct": 8, "correct_null": 2, "wrong": 1, "fabricated": 1, "missed": 1, "traps": 2, "traps_clean": 0, "trap_false_events": 1, "individual": 1, "messages": 4, "errors": 1}
    assert {k: row[k] for k in want} == want
    rates = scoring.metrics(total).first()
    assert rates["field_accuracy_all"] == pytest.approx(8 / 11) and rates["fabrication_rate"] == pytest.approx(1 / 3) and rates["correct_reject_rate"] == 0
    statuses = {(r.message_id, r.status) for r in scoring.alignment_rows(scores).collect()}
    assert statuses == {(1, "paired"), (2, "false_event")}


@pytest.mark.parametrize("field, gold, keys, said, same", [
    ("target_audience", "2 курс", [["2 курс"]], "студенти 2-го курсу", True), ("target_audience", "2 курс", [["2 курс"]], "студенти 3-го курсу", False),
    ("location", "Онлайн (Zoom)", [["онлайн", "zoom"]], "Zoom", True), ("location", "ауд. 305 корпусу 2", [["305"], ["корпус"]], "ауд. 305", False),
    ("location", "ауд. № 305", [["№ 305"]], "Ауд. № 305", True), ("location", "x", [[]], "x", False), ("organizer", "Straße", None, "die STRASSE", True),
    ("meeting_code", "ID 958 7048 5650 · код 326210", [["95870485650"], ["326210"]], "95870485650 326210", True), ("meeting_code", "c", [["95870485650"], ["326210"]], "ID 958 7048 5650", False),
])
def test_keyed_fields(spark, field, gold, keys, said, same):
    g = _events(spark, "gold_idx", [(1, 0, {"event_title": "t", "date": "2026-10-12", field: gold})])
    g = g.withColumn(f"{field}_keys", F.lit(None).cast("array<array<string>>") if keys is None else F.from_json(F.lit(json.dumps(keys)), "array<array<string>>"))
    p = _events(spark, "pred_idx", [(1, 0, {"event_title": "t", "date": "2026-10-12", field: said})])
    cells = {r.field: r.category for r in scoring.field_scores(scoring.scored(_kinds(spark, "announcement"), g, p)).collect()}
    assert cells[field] == ("correct" if same else "wrong")


def test_intervals_hold_the_observed_value(spark):
    rows = [(i, "announcement" if i % 5 else "trap", *[int(i * 7919 % 11 < 8) * (c in ("correct",)) + (c in ("gold_fields_total", "paired_fields", "traps")) for c in scoring._RATED]) for i in range(400)]
    counters = spark.createDataFrame(rows, "message_id long, kind string, " + ", ".join(f"{c} long" for c in scoring._RATED))
    found = {r.metric: r for r in scoring.bootstrap_intervals(counters, resamples=300).collect()}
    rate = scoring.metrics(scoring.summed(counters)).first()["field_accuracy_all"]
    r = found["field_accuracy_all"]
    deviation = (rate * (1 - rate) / 400) ** 0.5
    assert r.low < rate < r.high and r.high - r.low == pytest.approx(2 * 1.96 * deviation, rel=0.15)
    assert set(found) == {"field_accuracy_all", "correct_reject_rate"}
    again = {x.metric: x for x in scoring.bootstrap_intervals(counters.repartition(3), resamples=300).collect()}
    assert again["field_accuracy_all"].low == pytest.approx(r.low)
    same = scoring.paired_difference(counters, counters, resamples=50).first()
    assert (same["observed"], same["low"], same["high"]) == (0.0, 0.0, 0.0)


def test_draws_of_blocks_are_as_many_as_messages(spark):
    from eventloom.operators import scoring

    rows = scoring.draws_of_blocks(spark, [300, 0, 100, 600], 200).collect()
    of_draw, of_block = {}, {}
    for r in rows:
        of_draw[r.draw] = of_draw.get(r.draw, 0) + r.times
        of_block[r.block] = of_block.get(r.block, 0) + r.times
    assert len(of_draw) == 200 and set(of_draw.values()) == {1000}
    assert of_block[1] == 0 and abs(of_block[0] / 200 - 300) < 5 and abs(of_block[3] / 200 - 600) < 5


def test_cursor_and_pages(spark):
    assert feed.decode_cursor("2024-01-01T00:00:00|7") == (dt.datetime(2024, 1, 1), 7)
    for bad in ("", "x", "2024|"):
        with pytest.raises(ValueError):
            feed.decode_cursor(bad)
    with pytest.raises(ValueError):
        feed.feed(spark.range(1), limit=501)
    moment = dt.datetime(2024, 1, 1)
    rows = [(i, moment + dt.timedelta(hours=i // 4), ["approved", "rejected"][i % 2]) for i in range(23)]
    events = spark.createDataFrame(rows, "id long, updated_at timestamp_ntz, status string")
    seen, cursor = [], None
    while True:
        page = feed.sync_page(events, moment + dt.timedelta(days=9), cursor, limit=5)
        seen += [r["id"] for r in page["changed"]] + page["removed"]
        cursor = page["cursor"]
        if not page["has_more"]:
            break
    assert sorted(seen) == list(range(23))


def test_index_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    row = reports.placed_values(df.withColumn("model", F.lit("m")), "model", "v", {"m": reports.upper_median, "p": reports.p95}).first()
    assert (row["m"], row["p"]) == (6.0, 10.0)
    # One value holds most rows, and one lies far off.
    rows = [("a", 3.0)] * 90 + [("a", 1e6), ("a", -5.5), ("a", None)] + [("b", 2.0)]
    found = {r.model: (r["m"], r["p"]) for r in reports.placed_values(spark.createDataFrame(rows, "model string, v double"), "model", "v", {"m": reports.upper_median, "p": reports.p95}).collect()}
    assert found == {"a": (3.0, 3.0), "b": (2.0, 2.0)}


def test_unreadable_answers_are_asked_for_again(spark):
    from eventloom.plans.extract import ask, failures, valid_events

    good = '{"events": [{"event_title": "x", "event_type": "other"}]}'

    def chat(talk, schema):
        text, n = talk[-1 if len(talk) == 1 else 0]["content"], (len(talk) + 1) // 2
        if "never" in text:
            return '{"events": [{"event_title": "x", "date": "2026-13-40"}]}' if n > 1 else "no json"
        if "down" in text:
            raise TimeoutError("too slow")
        if "refused" in text:
            raise ConnectionRefusedError("no server")
        return good if n > 1 or "first" in text else "[]"

    rows = [(i, "@a", t, dt.date(2024, 1, 1)) for i, t in enumerate(["never", "down", "refused", "first", "second"])]
    posts = spark.createDataFrame(rows, "message_id long, channel string, text string, ref_date date")
    answers = {r.text: r for r in ask(posts, chat).collect()}
    assert {t: (r.attempts, r.error) for t, r in answers.items()} == {
        "never": (3, "invalid"), "down": (3, "unavailable"), "refused": (1, "unavailable"), "first": (1, None), "second": (2, None),
    }
    assert "TimeoutError" in answers["down"].error_text and valid_events(ask(posts, chat)).count() == 2
    # What is unavailable goes back to the queue; what stays bad is closed.
    assert {r.message_id: r.again for r in failures(ask(posts, chat)).collect()} == {0: False, 1: True, 2: True}


def test_recovery_after_a_transport_error(spark):
    from eventloom.plans.extract import _answer

    calls = []

    def chat(talk, schema):
        calls.append(len(talk))
        if len(calls) == 1:
            raise TimeoutError("blip")
        return '{"events": []}'

    assert _answer([{"role": "user", "content": "t"}], chat, "", 2) == ('{"events": []}', 2, None, None) and calls == [1, 1]


def test_numbers_of_reports_round_the_binary_value(spark):
    """Ties go to even and near ties to where the value stands, as Python's and SQL's own formats do."""
    values = [0.125, 0.375, 1.005, 2.675, 6.25, 2344.5, -1.125, 1234567.895, 0.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert [r.n for r in df.select(review.number(F.col("v"), 2).alias("n")).collect()] == [*(f"{v:.2f}" for v in values), "—"]
    parts = spark.createDataFrame([(1, 16), (3, 16), (1, 3), (1, 0)], "a long, b long")
    assert [r.s for r in parts.select(review.share(F.col("a"), F.col("b")).alias("s")).collect()] == ["6.2%", "18.8%", "33.3%", "—"]
