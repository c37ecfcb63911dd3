"""Registered queries of what keeps state: stored tables, streams, exact upserts, run folders."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import exact, reports
from eventloom.operators.stored_events import StoredEvents, changes_from_log
from eventloom.plans import evaluate
from eventloom.plans import fixtures as fx
from eventloom.plans.queries import _DUE, _FATES, _HASH, _RATES, _aligned_sql, _as_text, _cells_sql, _counted_sql, _fates, query
from eventloom.sources.gold import load_gold
from eventloom.sources.run_folders import read_run_folder, write_run_folder
from eventloom.sources.scratch import shared_path
from eventloom.streaming import state
from eventloom.streaming.ingest import ingest_live, run_available, upsert_stream

# Stored events: the documents as posts that come in four batches

BATCHES, BUCKETS = 4, 16
#: The moment of a batch.
_CLOCK = [f"2024-02-0{b + 1}T00:00:00" for b in range(BATCHES)]
_TITLE = "lang || ' ' || (n_chars % 10)::VARCHAR"
_POSTS = f"""posts AS MATERIALIZED (
  SELECT '@' || source AS channel, doc_id % 25 AS message_id, {_TITLE} AS event_title, CASE WHEN doc_id % 10 <> 0 THEN DATE '2024-01-01' + (doc_id % 20)::INT END AS date, doc_id AS ordinal,
         ({BATCHES} * doc_id) // (SELECT max(doc_id) + 1 FROM documents) AS b FROM documents),
hashed AS MATERIALIZED (SELECT *, {_HASH} AS h FROM posts)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts whose keys and titles repeat; ``b`` is the batch that each comes with."""
    d, n = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    last = d.agg(F.max("doc_id")).first()[0]
    return d.select(
        F.concat(F.lit("@"), "source").alias("channel"), (n % 25).alias("message_id"), F.concat("lang", F.lit(" "), (F.col("n_chars") % 10).cast("string")).alias("event_title"),
        F.when(n % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int"))).alias("date"), n.alias("ordinal"), F.floor(BATCHES * n / (last + 1)).alias("b"),
    )


def _merged_sql() -> str:
    """s<b>: the table after batch b; m<b> and f<b>: the rows that overwrite and those that are new."""
    out = ["s_1 AS (SELECT 0::BIGINT AS id, '' AS channel, 0::BIGINT AS message_id, '' AS event_title, NULL::DATE AS date, '' AS h, '' AS status, '' AS moved WHERE false)"]
    for b in range(BATCHES):
        before = "s_1" if b == 0 else f"s{b - 1}"
        out.append(f"""n{b} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel, message_id ORDER BY ordinal DESC) AS n FROM hashed WHERE b = {b}) WHERE n = 1),
m{b} AS MATERIALIZED (SELECT n.*, s.id AS old_id, s.status AS old_status, s.h AS old_h, n.h IN (SELECT h FROM {before}) AS known FROM n{b} n LEFT JOIN {before} s ON s.channel = n.channel AND s.message_id = n.message_id),
f{b} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ordinal) AS first FROM m{b} WHERE old_id IS NULL AND NOT known) WHERE first = 1),
s{b} AS MATERIALIZED (SELECT * FROM {before} WHERE id NOT IN (SELECT old_id FROM m{b} WHERE old_id IS NOT NULL)
  UNION ALL SELECT old_id, channel, message_id, event_title, date, h, old_status, '{_CLOCK[b]}' FROM m{b} WHERE old_id IS NOT NULL
  UNION ALL SELECT ordinal, channel, message_id, event_title, date, h, 'pending', '{_CLOCK[b]}' FROM f{b})""")
    return ", ".join(out)


_MERGED = f"{_POSTS}, {_merged_sql()}"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[StoredEvents, list[dict[str, list[int]]]]:
    """The stored events after all batches, and the buckets that each wrote. Each batch is delivered twice."""
    events = StoredEvents(spark, shared_path(spark), BUCKETS)
    rows, wrote = posts(spark, sf_dir), []
    for b, now in enumerate(_CLOCK):
        batch = rows.where(F.col("b") == b).drop("b")
        wrote.append(events.upsert(batch, now, "posts", b))
        assert not any(events.upsert(batch, now, "posts", b).values())
    return events, wrote


@query(f"""WITH {_MERGED} SELECT id, channel, message_id, event_title, strftime(date, '%Y-%m-%d') AS date, h AS content_hash, status, replace(moved, 'T', ' ') AS updated_at FROM s{BATCHES - 1}""")
def stored_upserts(spark, sf_dir):
    """All documents upserted into a stored table, batch by batch."""
    return _as_text(_stored(spark, sf_dir)[0].read().drop("time"))


def _bucket_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT % {BUCKETS}"


@query(f"""WITH {_MERGED} {" UNION ALL ".join(f"""SELECT {b}::BIGINT AS batch, 'events' AS name, {_bucket_sql("channel || '|' || message_id::VARCHAR")} AS bucket FROM (SELECT channel, message_id FROM m{b} WHERE old_id IS NOT NULL UNION SELECT channel, message_id FROM f{b}) GROUP BY ALL
UNION ALL SELECT {b}, 'hashes', {_bucket_sql("h")} FROM (SELECT h FROM (SELECT h, 1 AS n FROM m{b} WHERE old_id IS NOT NULL UNION ALL SELECT old_h, -1 FROM m{b} WHERE old_id IS NOT NULL UNION ALL SELECT h, 1 FROM f{b}) GROUP BY h HAVING sum(n) <> 0) GROUP BY ALL""" for b in range(BATCHES))}""")
def stored_buckets(spark, sf_dir):
    """The buckets that each batch writes: those its rows fall in."""
    wrote = _stored(spark, sf_dir)[1]
    rows = [(b, name, k) for b, one in enumerate(wrote) for name, buckets in one.items() for k in buckets]
    return spark.createDataFrame(rows, "batch long, name string, bucket long")


@query(f"""WITH {_MERGED} {" UNION ALL ".join(f"SELECT {b}::BIGINT AS v, 'update' AS op, old_id AS id, event_title, h AS content_hash FROM m{b} WHERE old_id IS NOT NULL UNION ALL SELECT {b}, 'insert', ordinal, event_title, h FROM f{b}" for b in range(BATCHES))}""")
def changelog_stream(spark, sf_dir):
    """Every change of the stored table, as a stream of its log tells it."""
    events, _ = _stored(spark, sf_dir)
    out = shared_path(spark)
    run_available(events.store.log_stream(), shared_path(spark), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema("v long, op string, id long, event_title string, content_hash string").parquet(f"{out}/batch=*")


_PAGE_CURSOR = f"{_CLOCK[1]}|5"
_PAGE_AFTER = f"(moved > '{_CLOCK[1]}' OR (moved = '{_CLOCK[1]}' AND id > 5))"


@query(f"""WITH {_MERGED}, a AS (SELECT id, event_title, CASE WHEN id % 2 = 0 THEN 'approved' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN '{_CLOCK[3]}' ELSE moved END AS moved FROM s{BATCHES - 1})
SELECT id, event_title, status, replace(moved, 'T', ' ') AS updated_at FROM a WHERE status = 'approved' AND {_PAGE_AFTER} ORDER BY moved, a.id LIMIT 100""")
def changelog_page(spark, sf_dir):
    """A page of the change feed after a cursor, from the log alone; half of the events were approved."""
    events, _ = _stored(spark, sf_dir)
    events.set_status(F.col("id") % 2 == 0, "approved", _CLOCK[3])
    return _as_text(changes_from_log(events.store.log(), _PAGE_CURSOR).select("id", "event_title", "status", "updated_at"))


_KEEP, _PURGE, _SEEN = 3, 7, "2024-01-15T12:00:00"


@query(f"""WITH {_MERGED}, x AS (SELECT id, h, coalesce(date <= DATE '2024-01-15' - {_KEEP} AND date <= TIMESTAMP '{_SEEN}' - INTERVAL {_KEEP} DAY, false) AS due, coalesce(date < DATE '2024-01-15' - {_PURGE}, false) AS old FROM s{BATCHES - 1}),
k AS (SELECT id, CASE WHEN due THEN 'expired' ELSE 'pending' END AS status, h FROM x WHERE NOT (due AND old))
SELECT id, status, h AS content_hash, (SELECT count(*) FROM k z WHERE z.h = k.h) AS rows_of_hash FROM k""")
def stored_cleanup(spark, sf_dir):
    """Retention on the stored table, with the number of rows that the index has of each hash."""
    events, _ = _stored(spark, sf_dir)
    events.cleanup(_KEEP, _PURGE, _SEEN)
    index = events.store.read("hashes").withColumnRenamed("rows", "rows_of_hash")
    return events.read().select("id", "status", "content_hash").join(index, "content_hash")


@query(f"""WITH {_MERGED} SELECT id, channel, message_id, event_title, h AS content_hash FROM s{BATCHES - 1}""")
def stream_upserts(spark, sf_dir):
    """The same batches as a stream of files into the stored table."""
    source, path, checkpoint = shared_path(spark), shared_path(spark), shared_path(spark)
    rows = posts(spark, sf_dir)
    for b in range(BATCHES):
        rows.where(F.col("b") == b).drop("b").coalesce(1).write.parquet(f"{source}/{b}")
        stream = spark.readStream.schema(rows.drop("b").schema).parquet(f"{source}/*")
        upsert_stream(stream, path, checkpoint, _CLOCK.__getitem__, buckets=BUCKETS)
    return StoredEvents(spark, path, BUCKETS).read().select("id", "channel", "message_id", "event_title", "content_hash")


# Row-by-row upserts across channels


@query(f"""WITH RECURSIVE {_POSTS}, s AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS k FROM hashed), f AS (
  SELECT 0::BIGINT AS k, []::STRUCT(id BIGINT, c VARCHAR, m BIGINT, t VARCHAR, d DATE, h VARCHAR)[] AS st
  UNION ALL
  SELECT s.k, CASE
    WHEN len(list_filter(f.st, lambda e: e.m = s.message_id AND e.c = s.channel)) > 0
      THEN list_transform(f.st, lambda e: CASE WHEN e.m = s.message_id AND e.c = s.channel THEN {{'id': e.id, 'c': e.c, 'm': e.m, 't': s.event_title, 'd': s.date, 'h': s.h}} ELSE e END)
    WHEN list_contains(list_transform(f.st, lambda e: e.h), s.h) THEN f.st
    ELSE list_append(f.st, {{'id': s.ordinal, 'c': s.channel, 'm': s.message_id, 't': s.event_title, 'd': s.date, 'h': s.h}}) END
  FROM f JOIN s ON s.k = f.k + 1
) SELECT e.id AS id, e.c AS channel, e.m AS message_id, e.t AS event_title, strftime(e.d, '%Y-%m-%d') AS date, e.h AS content_hash FROM (SELECT unnest(arg_max(st, k)) AS e FROM f)""")
def upsert_exact(spark, sf_dir):
    """All posts one after the other, with titles that channels share, by rounds over sets."""
    return _as_text(exact.exact_upserts(posts(spark, sf_dir).drop("b")))


# State in streams


@query(f"WITH {fx.CALENDAR}, {_FATES} SELECT id AS ordinal, fate FROM d")
def stream_fates(spark, sf_dir):
    """First of a hash by the stream's own state: the same fates as ``dedup_cross_run``, row by row."""
    fates = _fates(spark, sf_dir)
    rows = fates.select("index", "ordinal", "content_hash", reports.gate().alias("gate"))
    source, out, checkpoint = (shared_path(spark) for _ in range(3))
    last = rows.agg(F.max("index")).first()[0] or 0
    # Three parts in order of the messages, each worked through before the next comes.
    for part in range(3):
        rows.where(F.floor(F.col("index") * 3 / (last + 1)) == part).write.parquet(f"{source}/{part}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        state.run_to_files(state.first_of_hash(stream), out, checkpoint)
    return spark.read.parquet(out).select("ordinal", "fate")


def _with_tick(spark: SparkSession, rows: DataFrame, tick: DataFrame, operator) -> DataFrame:
    """What an operator tells of the rows, and once its clock has come to the tick, a row that advances the watermark."""
    source, out, checkpoint = (shared_path(spark) for _ in range(3))
    for part, df in enumerate((rows, tick)):
        df.write.parquet(f"{source}/{part}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        state.run_to_files(operator(stream), out, checkpoint)
    return spark.read.parquet(out)


@query(f"""WITH {fx.CALENDAR}, x AS (SELECT id, date, CASE WHEN {_DUE} THEN 'expired' ELSE status END AS status FROM cal)
SELECT id, status FROM x WHERE NOT coalesce(status = 'expired' AND date < DATE '{fx.TODAY}' - 7, false)""")
def stream_retention(spark, sf_dir):
    """Retention by timers in state, at the moment that ``cleanup`` is run for: the same events are left, with the same status."""
    cal = fx.calendar(spark, sf_dir)
    moment = lambda text: F.lit(text).cast("timestamp")
    rows = cal.select("id", "date", "time", "status", moment("2024-01-01T00:00:00").alias("seen_at"))
    now = dt.datetime.fromisoformat(fx.NOW) + dt.timedelta(milliseconds=1)
    tick = spark.createDataFrame([(-1, None, None, "", now)], "id long, date date, time string, status string, seen_at timestamp_ntz").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    told = _with_tick(spark, rows, tick, lambda s: state.retention(s, 3, 7))
    last = told.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("told"))
    left = cal.select("id", "status").join(last, "id", "left").where("coalesce(told, '') <> 'purged'")
    return left.select("id", F.coalesce("told", "status").alias("status"))


@query(f"""WITH {fx.JOBS} SELECT id, n::INT AS attempts, CASE WHEN n > attempts THEN 'done' WHEN n = 4 THEN 'failed' ELSE 'queued' END AS status,
strftime(TIMESTAMP '2024-01-01' + to_seconds((id % 3600 + 30 * (2 ** (n - 1) - 1))::INT), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN n <= attempts THEN 'timeout ' || n::VARCHAR END AS error
FROM jobs, range(1, 5) t(n) WHERE n <= attempts + 1""")
def stream_retries(spark, sf_dir):
    """Jobs that fail as often as their ``attempts`` say, tried again by timers with waits that double, given up after four."""
    start = F.lit("2024-01-01T00:00:00").cast("timestamp")
    rows = fx.jobs(spark, sf_dir).select("id", (start + F.make_dt_interval(secs=F.col("id") % 3600)).alias("submitted_at"), F.col("attempts").alias("fails"))
    tick = spark.createDataFrame([(-1, 0)], "id long, fails int").select("id", (start + F.make_dt_interval(hours=F.lit(3))).alias("submitted_at"), "fails")
    told = _with_tick(spark, rows, tick, lambda s: state.with_retries(s, lambda r, n: f"timeout {n}" if n <= r["fails"] else None, "fails int", 30, 4))
    return _as_text(told.where("id >= 0"))


# Live posts


_LIVE = """live AS (SELECT doc_id AS message_id, doc_id % 7 AS chat_id, CASE WHEN doc_id % 3 <> 0 THEN upper(source) END AS username, CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END AS text,
  CASE WHEN doc_id % 10 = 0 THEN 'caption ' || doc_id::VARCHAR END AS caption, DATE '2024-01-01' + (doc_id % 30)::INT AS day, 2 * doc_id // (SELECT max(doc_id) + 1 FROM documents) AS b FROM documents)"""


def _live_sql(b: int, names: tuple[str, ...], chats: tuple[int, ...]) -> str:
    listed = f"lower(username) IN ({', '.join(repr(n) for n in names)}) OR chat_id IN ({', '.join(map(str, chats))})"
    return f"""SELECT coalesce('@' || username, chat_id::VARCHAR) AS channel, message_id, md5(coalesce(nullif(text, ''), caption)) AS text, strftime(day, '%Y-%m-%d') AS ref_date
FROM live WHERE b = {b} AND coalesce(nullif(text, ''), nullif(caption, '')) IS NOT NULL AND ({listed})"""


_LISTS = [(("src1", "src2", "src3"), (4,)), (("src3", "src5"), (2, 6))]


@query(f"WITH {_LIVE} {' UNION ALL '.join(_live_sql(b, *listed) for b, listed in enumerate(_LISTS))}")
def stream_live_posts(spark, sf_dir):
    """Documents as live posts in two micro-batches; the list of channels changes between them."""
    d, n = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    last = d.agg(F.max("doc_id")).first()[0]
    rows = d.select(
        n.alias("message_id"), (n % 7).alias("chat_id"), F.when(n % 3 != 0, F.upper("source")).alias("username"), F.when(n % 5 != 0, F.col("text")).otherwise("").alias("text"),
        F.when(n % 10 == 0, F.concat(F.lit("caption "), n.cast("string"))).alias("caption"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 30).cast("int")).cast("timestamp").alias("posted_at"),
        F.floor(2 * n / (last + 1)).alias("b"),
    )
    source, listed, out, checkpoint = (shared_path(spark) for _ in range(4))
    for b, (names, chats) in enumerate(_LISTS):
        channels = [(f"@{c.title()}",) for c in names] + [(str(c),) for c in chats]
        spark.createDataFrame(channels, "channel string").coalesce(1).write.mode("overwrite").parquet(listed)
        rows.where(F.col("b") == b).drop("b").write.parquet(f"{source}/{b}")
        stream = spark.readStream.schema(rows.drop("b").schema).parquet(f"{source}/*")
        ingest_live(stream, listed, out, checkpoint)
    kept = spark.read.schema("channel string, message_id long, text string, ref_date date").parquet(f"{out}/batch=*")
    return _as_text(kept.withColumn("text", F.md5(F.encode("text", "utf-8"))))


# Saved runs and gold sets, from files


def _gold_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    fx.gold_set(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return load_gold(spark, path)


def _run_folder(spark: SparkSession, sf_dir: str) -> str:
    runs = fx.run_records(spark, sf_dir)
    path = shared_path(spark)
    write_run_folder(path, runs, {"models": ["p7", "p3"], "prompt_sha256": "one"}, {}, runs.groupBy("model").agg(F.count(F.lit(1)).alias("records")))
    return path


_VIEWS = ", ".join(
    f"{fx.predicted_sql(p, n)}, {fx.filtered_sql('f' + p, p)}, " + ", ".join(f"{_aligned_sql(v)}, {_cells_sql(v)}, {_counted_sql(v)}" for v in (p, f"f{p}")) for p, n in (("p7", 7), ("p3", 3))
)


def _view_sql(model: str, view: str, pred: str) -> str:
    # Individual messages of which something was said and nothing outlasts the filters.
    dropped = f"SELECT count(*) FROM ct_{model} c WHERE c.individual = 1 AND c.individual_extracted = 1 AND c.message_id NOT IN (SELECT message_id FROM f{model})" if view == "raw" else "SELECT 0"
    counts = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("messages", "errors", "traps", "traps_clean", "individual", "individual_extracted", "extra_events", "missed_events"))
    return f"SELECT '{model}' AS model, '{view}' AS view, {_RATES}, {counts}, ({dropped})::BIGINT AS individual_dropped FROM ct_{pred}"


@query(f"""WITH RECURSIVE {fx.GOLD}, {fx.SCORED}, {_VIEWS} {" UNION ALL ".join(_view_sql(m, v, p) for m in ("p7", "p3") for v, p in (("raw", m), ("filtered", f"f{m}")))}""")
def run_views(spark, sf_dir):
    """Saved runs of two models against a gold set, both read from files: as answered, and after the filters."""
    _, runs = read_run_folder(spark, _run_folder(spark, sf_dir))
    return evaluate.score_table(runs, _gold_file(spark, sf_dir))


@query(f"""WITH {fx.GOLD}, {fx.predicted_sql("p7", 7)}, {fx.predicted_sql("p3", 3)}, {fx.SCORED}, m AS (SELECT message_id AS id, failed FROM scored), a AS (SELECT 'p7' AS model, * FROM p7 UNION ALL SELECT 'p3', * FROM p3),
e AS (SELECT model, message_id, count(*) AS n, min(event_title) AS title FROM a GROUP BY ALL), r AS (SELECT v.model, id, failed, coalesce(n, 0) AS n, title FROM (SELECT * FROM m, (VALUES ('p7'), ('p3')) x(model)) v LEFT JOIN e ON e.model = v.model AND e.message_id = v.id)
SELECT model, CASE WHEN s THEN id ELSE -1 - id END AS message_id, n AS events, title, CASE WHEN failed THEN 'unavailable' END AS error, (id % 7) / 2.0::DOUBLE AS seconds FROM r, (VALUES (true), (false)) t(s)""")
def run_folder(spark, sf_dir):
    """Run records written as one whole folder and read back."""
    meta, runs = read_run_folder(spark, _run_folder(spark, sf_dir))
    assert json.loads(json.dumps(meta))["models"] == ["p7", "p3"]
    return runs.select("model", "message_id", F.size("events").cast("long").alias("events"), F.array_min(F.transform("events", lambda e: e["event_title"])).alias("title"), "error", "seconds")

