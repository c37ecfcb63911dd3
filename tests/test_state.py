"""Stored tables, streams with state, exact upserts, run folders, draws: what queries over the tables don't show."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.operators import exact, scoring, store
from eventloom.operators.stored_events import StoredEvents, changes_from_log, latest_of_log
from eventloom.sources.run_folders import TornFolder, read_run_folder, write_run_folder
from eventloom.streaming import state
from eventloom.streaming.ingest import live_posts

POST = "channel string, message_id long, event_title string, date date, ordinal long"
DAY = dt.date(2024, 1, 1)


def some_posts(seed, n, keys, titles, start=0):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(keys)]), f"t{rng.randrange(titles)}", DAY, start + i) for i in range(n)]


def test_batches_write_their_buckets_once(spark, tmp_path):
    events = StoredEvents(spark, str(tmp_path / "t"), 8)
    parts = [[("a", 1, "x", DAY, 1), ("a", 2, "y", DAY, 2), (None, None, "x", DAY, 3)], [("a", 1, "z", DAY, 4), ("b", 9, "y", DAY, 5), ("b", 8, "new", None, 6)]]
    current = spark.createDataFrame([], "channel string, message_id long, event_title string, date date, content_hash string, status string")
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, POST)
        wrote = events.upsert(batch, f"2024-01-0{n + 1}T00:00:00", "s", n)
        held = events.store.manifest()
        new = {int(b) for b, v in held["buckets"]["events"].items() if v == n}
        assert set(wrote["events"]) >= new and len(wrote["events"]) <= len(part)
        assert not any(events.upsert(batch, "2024-02-01T00:00:00", "s", n).values()) and events.store.manifest() == held
        current = store.merge_batch(current, batch)
    assert Counter(map(tuple, events.read().select(*current.columns).collect())) == Counter(map(tuple, current.collect()))
    assert {r.op: r["count"] for r in events.store.log().groupBy("op").count().collect()} == {"insert": 3, "update": 1}
    events.set_status(F.col("id") == 1, "approved", "2024-01-03T00:00:00")
    events.cleanup(3, 7, "2024-02-03T00:00:00")
    assert [r.id for r in events.read().collect()] == [6] and [r.rows for r in events.store.read("hashes").collect()] == [1]
    assert Counter(map(tuple, latest_of_log(events.store.log()).collect())) == Counter(map(tuple, events.read().collect()))
    assert changes_from_log(events.store.log()).count() == 0
    # An older version stands until it is cleared.
    assert events.store.read("events", version=1).count() == 3
    assert events.store.vacuum() > 0 and events.store.versions() == [3] and events.read().count() == 1


def test_a_writer_that_stops_half_way(spark, tmp_path, monkeypatch):
    events = StoredEvents(spark, str(tmp_path / "t"), 4)
    batch = spark.createDataFrame(some_posts(1, 30, 10, 12), POST)

    def stop(*_):
        raise RuntimeError("stopped")

    # Before its manifest nothing counts.
    monkeypatch.setattr(events.store, "_publish", stop)
    with pytest.raises(RuntimeError):
        events.upsert(batch, "2024-01-01T00:00:00", "s", 0)
    monkeypatch.undo()
    assert events.read().count() == 0
    # After it the next writer publishes the log.
    published = events.store.recover
    monkeypatch.setattr(events.store, "recover", lambda: None)
    events.upsert(batch, "2024-01-01T00:00:00", "s", 0)
    monkeypatch.undo()
    again = StoredEvents(spark, str(tmp_path / "t"), 4)
    assert again.store.seen("s", 0) and not (tmp_path / "t/log").exists()
    again.upsert(batch, "2024-01-02T00:00:00", "s", 1)
    assert Counter(map(tuple, latest_of_log(again.store.log()).collect())) == Counter(map(tuple, again.read().collect()))
    published()
    with pytest.raises(RuntimeError, match="another writer"):
        again.store._publish(again.store.manifest())


@pytest.mark.parametrize(("seed", "n", "keys", "titles"), [(0, 300, 40, 30), (1, 300, 200, 8), (2, 200, 5, 5)])
def test_exact_upserts_are_those_row_by_row(spark, seed, n, keys, titles):
    df = spark.createDataFrame(some_posts(seed, n, keys, titles), POST)
    columns = ["channel", "id", "message_id", "event_title", "date", "content_hash"]
    want = store.fold_batch(df, F.lit(1)).select(*columns)
    assert Counter(map(tuple, exact.exact_upserts(df, 60).select(*columns).collect())) == Counter(map(tuple, want.collect()))


def test_exact_upserts_of_nothing(spark):
    assert exact.exact_upserts(spark.createDataFrame([], POST)).count() == 0


def run_by_the_clock(spark, stream, tmp_path, schema, n):
    """A stream whose timers go by the machine's clock runs until it is stopped: here, when so many rows are there."""
    out, rows = tmp_path / "out", []
    with state.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
        for _ in range(40):
            query.awaitTermination(1)
            rows = spark.read.schema(schema).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
            if len(rows) >= n:
                break
        query.stop()
    return rows


def test_hashes_are_forgotten_when_asked(spark, tmp_path):
    rows = [(i, i, f"h{i % 3}", "filtered" if i == 0 else None) for i in range(7)]
    schema = "index long, ordinal long, content_hash string, gate string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = run_by_the_clock(spark, state.first_of_hash(stream, ttl_ms=3_600_000), tmp_path, "ordinal long, fate string, first_index long", 7)
    found = {r.ordinal: (r.fate, r.first_index) for r in rows}
    assert found == {0: ("filtered", None), 1: ("saved", None), 2: ("saved", None), 3: ("saved", None), 4: ("duplicate", 1), 5: ("duplicate", 2), 6: ("duplicate", 3)}


def test_retries_by_the_machines_clock(spark, tmp_path):
    schema = "id long, submitted_at timestamp, fails int"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 0), (2, dt.datetime(2024, 1, 1), 1), (3, dt.datetime(2024, 1, 1), 9)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    told = state.with_retries(stream, lambda r, n: "no" if n <= r["fails"] else None, "fails int", 1, 3, by_clock=True)
    rows = run_by_the_clock(spark, told, tmp_path, "id long, attempts int, status string", 6)
    assert Counter(map(tuple, rows)) == Counter([(1, 1, "done"), (2, 1, "queued"), (2, 2, "done"), (3, 1, "queued"), (3, 2, "queued"), (3, 3, "failed")])


def test_an_empty_list_allows_all_channels(spark):
    posts = spark.createDataFrame([(5, None, 1, "a", None, DAY), (6, "News", 2, None, "b", DAY), (7, "", 3, "", "", DAY)], "chat_id long, username string, message_id long, text string, caption string, posted_at date")
    nothing = spark.createDataFrame([], "channel string")
    assert Counter(map(tuple, live_posts(posts, nothing).select("channel", "text").collect())) == Counter([("5", "a"), ("@News", "b")])
    one = spark.createDataFrame([("@NEWS",)], "channel string")
    assert [r.message_id for r in live_posts(posts, one).collect()] == [2]


def test_run_folders_are_whole_or_refused(spark, tmp_path):
    runs = spark.createDataFrame([("m", 1, [("x",)], None, 1.5, "p")], "model string, message_id long, events array<struct<event_title:string>>, error string, seconds double, prompt_sha256 string")
    path = tmp_path / "run"
    write_run_folder(str(path), runs, {"model": "m"}, {"fields.csv": runs.select("model", "seconds")}, runs.select("model", "seconds"))
    meta, back = read_run_folder(spark, str(path))
    assert meta == {"model": "m"} and back.first().events[0].event_title == "x"
    assert (path / "summary.md").read_text().splitlines()[2] == "| m | 1.5 |"
    assert [p.name for p in tmp_path.iterdir()] == ["run"]
    with pytest.raises(FileExistsError):
        write_run_folder(str(path), runs, {}, {}, runs.select("model"))
    (path / "summary.md").write_text("changed")
    with pytest.raises(TornFolder, match="summary.md"):
        read_run_folder(spark, str(path))
    (path / "_COMPLETE").unlink()
    with pytest.raises(TornFolder, match="end"):
        read_run_folder(spark, str(path))


def test_resamples_draw_every_message_as_often(spark):
    counters = spark.range(1000).select(F.col("id").alias("message_id"), F.lit(1).cast("long").alias("messages"), (F.col("id") % 4 == 0).cast("long").alias("traps"))
    rows = scoring.resampled(counters, 400, block=128).collect()
    assert len(rows) == 400 and {r.messages for r in rows} == {1000}
    traps = [r.traps for r in rows]
    mean = sum(traps) / 400
    assert abs(mean - 250) < 4 and 120 < sum((t - mean) ** 2 for t in traps) / 400 < 260
    assert sorted(map(tuple, rows)) == sorted(map(tuple, scoring.resampled(counters.repartition(7), 400, block=128).collect()))


def test_gold_sets_by_line_and_as_one_array(spark, tmp_path):
    from eventloom.sources.gold import load_gold

    messages = [{"source_message_id": i, "date": "2024-01-01", "text": f"t{i}", "gold": {"kind": "trap", "category": "trap", "tags": [], "reaches_db": False, "events": []}} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(messages, indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, messages)))
    (tmp_path / "fix.json").write_text(json.dumps({"1": {"gold.kind": "individual", "reason": "r"}}))
    one, two = (load_gold(spark, str(tmp_path / f"{k}.json")) for k in "ab")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 3
    for k in "ab":
        assert {r.message_id: r.kind for r in load_gold(spark, str(tmp_path / f"{k}.json"), str(tmp_path / "fix.json")).collect()}[1] == "individual"
