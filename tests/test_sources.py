"""Gold sets, date checks, the facade and the streamed store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.engine import Engine
from eventloom.functions import grounding
from eventloom.operators.store import merge_batch
from eventloom.operators.stored_events import StoredEvents
from eventloom.plans import fixtures
from eventloom.sources import gold as golds

SF = "/root/testdata/sf0.001"
MONDAY = dt.date(2026, 11, 2)


@pytest.mark.parametrize("value, text, status", [
    (dt.date(2026, 5, 15), "15 травня збори", "suspect"), (dt.date(2026, 11, 15), "15-16 листопада", "ok"), (dt.date(2026, 11, 16), "з 15 по 16 листопада", "ok"),
    (dt.date(2026, 11, 17), "15.11 о 10:00", "invented"), (dt.date(2026, 11, 3), "завтра", "ok"), (dt.date(2026, 11, 4), "післязавтра", "invented"),
    (dt.date(2026, 11, 6), "у п'ятницю", "ok"), (dt.date(2026, 11, 6), "без дати", "invented"), (None, "завтра", "empty"), (dt.date(2026, 11, 15), "15 листопада 2025", "suspect"),
])
def test_date_status(spark, value, text, status):
    df = spark.createDataFrame([(value, text, MONDAY)], "v date, t string, r date")
    assert df.select(grounding.date_status(F.col("v"), F.col("t"), F.col("r")).alias("s")).first()["s"] == status


def test_event_checks_and_omissions(spark):
    row = ("Лекція про клімат", None, "14:30", None, None, None, "lecture", None, None, None, None, "Лекція про клімат о 14:30, https://a.ua", MONDAY)
    schema = ", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in grounding.CHECK_ORDER) + ", text string, ref date"
    df = spark.createDataFrame([row], schema)
    checks = {c["field"]: c["status"] for c in df.select(grounding.event_checks(F.col("text"), F.col("ref")).alias("c")).first()["c"]}
    assert list(checks) == grounding.CHECK_ORDER
    assert (checks["event_title"], checks["time"], checks["link"], checks["location"], checks["event_type"]) == ("ok", "ok", "missed", "empty", "info")
    lacks = lambda n, links, times: [tuple(x) for x in df.select(grounding.omissions(F.lit(n), F.lit(links), F.lit(times), F.col("text"), F.lit(True)).alias("o")).first()["o"]]
    assert lacks(0, 0, 0) == [("events", "missed")] and lacks(1, 0, 0) == [("link", "missed"), ("time", "missed")] and lacks(1, 1, 1) == []


def test_gold_and_corrections(spark, tmp_path):
    event = {f: {"value": None} for f in golds.FIELDS} | {"event_title": {"value": "Збори", "keys": [["збори"]]}, "date": {"value": "2026-10-12", "inferred": True}, "description": {"present": True}}
    raw = [{"source_message_id": 7, "date": "2026-10-01", "text": "t", "source_channel": "@a", "gold": {"kind": "announcement", "category": "c", "tags": ["boundary"], "reaches_db": True, "events": [event]}}]
    (tmp_path / "g.json").write_text(json.dumps(raw))
    (tmp_path / "c.json").write_text(json.dumps({"7": {"events[0].date.value": "2026-10-19", "reason": "r"}}))
    row = golds.gold_events(golds.load_gold(spark, str(tmp_path / "g.json"), str(tmp_path / "c.json"))).first()
    assert (row["date"], row["event_title"], row["description"], row["inferred"]) == ("2026-10-19", "Збори", "true", True)
    with pytest.raises(KeyError):
        golds.corrected(raw, {"8": {}})
    with pytest.raises(ValueError):
        golds.corrected(raw, {"7": {"events[x]": 1}})
    (tmp_path / "runs.jsonl").write_text('{"prompt_sha256": "a"}\n{"prompt_sha256": "b"}')
    with pytest.raises(ValueError):
        golds.load_runs(spark, str(tmp_path / "runs.jsonl"))


def test_engine(spark):
    engine = Engine(fixtures.calendar(spark, SF), fixtures.jobs(spark, SF))
    assert engine.feed(limit=5).count() == 5 and engine.event_detail(3).count() == 1 and engine.job(4).count() == 1
    assert engine.approve([4, 8], fixtures.NOW).where("id in (4, 8) and status = 'approved'").count() == 2
    assert engine.stats()[0].where("status = 'total'").first()["n"] == engine.events.count()


def test_streamed_upserts_equal_batches(spark, tmp_path):
    from eventloom.streaming.ingest import upsert_stream

    schema = "channel string, message_id long, event_title string, date date, ordinal long"
    day = dt.date(2024, 1, 1)
    parts = [[("a", 1, "x", day, 1), ("a", 2, "y", day, 2), (None, None, "x", day, 3)], [("a", 1, "z", day, 4), ("b", 9, "y", day, 5), ("b", 8, "new", None, 6)]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    current = spark.createDataFrame([], "channel string, message_id long, event_title string, date date, content_hash string, status string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), lambda n: f"2024-01-0{n + 1}T00:00:00", buckets=8)
    for part in parts:
        current = merge_batch(current, spark.createDataFrame(part, schema))
    got = StoredEvents(spark, str(tmp_path / "t"), 8).read().select(*current.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, current.collect()))
    assert got.count() == 3


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from eventloom.sources.messages import load_jsonl, numbered_lines

    lines = ["# a comment", *(json.dumps({"text": f"text {i} " + "x" * (i % 50), "date": "2024-01-03"}) if i % 7 else "" for i in range(2000))]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = numbered_lines(spark, str(tmp_path / "a.jsonl"))
        assert rows.rdd.getNumPartitions() > 1 and sorted((r["at"], r.line) for r in rows.collect()) == list(enumerate(lines, 1))
        messages = load_jsonl(spark, str(tmp_path / "a.jsonl"), "2024-01-01")[0]
        assert {r.message_id for r in messages.collect()} == {n for n, x in enumerate(lines, 1) if x.startswith("{")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_folders_and_reports(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"model": "m", "dataset": "d"}))
    runs = [{"model": "m", "message_id": 1, "events": [{"event_title": "a"}, {"event_title": "b"}], "prompt_sha256": "p"}, {"model": "m", "message_id": 2, "events": [], "prompt_sha256": "p"}]
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, runs)))
    meta, records = golds.load_run_folder(spark, str(tmp_path))
    assert meta["dataset"] == "d" and [(r.pred_idx, r.event_title) for r in golds.predicted_events(records).orderBy("pred_idx").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "reports").mkdir()
    for name in "xy":
        (tmp_path / f"reports/{name}.json").write_text(json.dumps({"meta": {"model": name, "think": False}, "records": [{"index": 0, "message_id": 1, "events": []}]}, indent=1))
    assert sorted((r.model, r.think_off, r.use_schema) for r in golds.load_reports(spark, str(tmp_path / "reports")).collect()) == [("x", True, True), ("y", True, True)]


def test_prompts(spark):
    from eventloom.plans.extract import build_messages, prompt_hash, quirks_for

    shots = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    assert [m["role"] for m in build_messages("p", "s", shots)] == ["system", "user", "assistant", "user"] and build_messages("p") == [{"role": "user", "content": "p"}]
    assert prompt_hash("s", shots) != prompt_hash("s", shots[:1]) and len(prompt_hash("s", [])) == 64
    table = {"qwen-4b": {"use_schema": False}}
    assert quirks_for("qwen-4b-q4", table) == quirks_for("qwen", table) == {"use_schema": False} and quirks_for("qwen4", table) == {}
