"""Every registered query of the engine, with the SQL it is held against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import grounding, meeting, rules, schedule
from eventloom.functions import text as texts
from eventloom.operators import dataset, feed, jobs, reports, review, scoring, store
from eventloom.plans import fixtures as fx
from eventloom.sources.scratch import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FIELDS = scoring.FIELDS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _as_text(df: DataFrame) -> DataFrame:
    """Dates and moments as text, which both engines write alike."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "date":
            out[name] = F.col(name).cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            out[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


_PAGE = "id, event_title, strftime(date, '%Y-%m-%d') AS date, time, event_type, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


# The feed and the change feed


@query(f"WITH {fx.CALENDAR} SELECT {_PAGE} FROM cal WHERE status = 'approved' ORDER BY cal.date NULLS LAST, id LIMIT 200 OFFSET 100")
def feed_page(spark, sf_dir):
    return _as_text(feed.feed(fx.calendar(spark, sf_dir), limit=200, offset=100))


@query(f"WITH {fx.CALENDAR} SELECT {_PAGE} FROM cal WHERE status = 'approved' AND cal.date >= DATE '{fx.TODAY}' ORDER BY cal.date NULLS LAST, id LIMIT 500")
def feed_upcoming(spark, sf_dir):
    return _as_text(feed.feed(fx.calendar(spark, sf_dir), limit=500, upcoming=True, asof=fx.TODAY))


@query(f"WITH {fx.CALENDAR} SELECT {_PAGE} FROM cal WHERE event_type = 'click' AND cal.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY cal.date NULLS LAST, id LIMIT 500")
def feed_by_type(spark, sf_dir):
    return _as_text(feed.feed(fx.calendar(spark, sf_dir), limit=500, status="all", event_type="click", date_from="2024-01-05", date_to="2024-01-20"))


@query(f"WITH {fx.CALENDAR} SELECT count(*) AS total FROM cal WHERE status = 'approved' AND date >= DATE '{fx.TODAY}'")
def feed_count(spark, sf_dir):
    return feed.feed_count(fx.calendar(spark, sf_dir), upcoming=True, asof=fx.TODAY)


@query(f"WITH {fx.CALENDAR} SELECT {_PAGE} FROM cal WHERE status IN ('approved', 'rejected', 'expired') ORDER BY cal.updated_at, id LIMIT 100")
def sync_first_page(spark, sf_dir):
    return _as_text(feed.changed_since(fx.calendar(spark, sf_dir)))


_CURSOR = ("2024-01-10T05:00:00", 2001)
_AFTER = f"(cal.updated_at > TIMESTAMP '{_CURSOR[0]}' OR (cal.updated_at = TIMESTAMP '{_CURSOR[0]}' AND id > {_CURSOR[1]}))"


@query(f"WITH {fx.CALENDAR} SELECT {_PAGE} FROM cal WHERE status IN ('approved', 'rejected', 'expired') AND {_AFTER} ORDER BY cal.updated_at, id LIMIT 1000")
def sync_after_cursor(spark, sf_dir):
    return _as_text(feed.changed_since(fx.calendar(spark, sf_dir), f"{_CURSOR[0]}|{_CURSOR[1]}", limit=1000))


@query(f"WITH {fx.CALENDAR}, p AS (SELECT * FROM cal WHERE status IN ('approved', 'rejected', 'expired') AND {_AFTER} ORDER BY updated_at, id LIMIT 1000) SELECT id FROM p WHERE status <> 'approved'")
def sync_removed(spark, sf_dir):
    page = feed.changed_since(fx.calendar(spark, sf_dir), f"{_CURSOR[0]}|{_CURSOR[1]}", limit=1000)
    return page.where("status <> 'approved'").select("id")


@query(f"WITH {fx.CALENDAR} SELECT id, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || '.000000|' || id::VARCHAR AS cursor, id AS back_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS back_at FROM cal")
def cursor_roundtrip(spark, sf_dir):
    coded = fx.calendar(spark, sf_dir).select("id", feed.encode_cursor(F.col("updated_at"), F.col("id")).alias("cursor"))
    at, back = feed.cursor_columns(F.col("cursor"))
    return _as_text(coded.select("id", "cursor", back.alias("back_id"), at.alias("back_at")))


@query(f"""WITH {fx.CALENDAR}, k(status) AS (VALUES ('pending'), ('approved'), ('rejected'), ('expired'))
SELECT k.status, count(cal.id)::BIGINT AS n FROM k LEFT JOIN cal USING (status) GROUP BY k.status UNION ALL SELECT 'total', count(*)::BIGINT FROM cal""")
def status_counts(spark, sf_dir):
    return feed.status_counts(fx.calendar(spark, sf_dir))


# The store


_START = "date + (CASE WHEN regexp_full_match(time, '([01]?[0-9]|2[0-3]):[0-5]?[0-9]') THEN time ELSE '00:00' END)::TIME"
_DUE = f"status IN ('approved', 'pending') AND date <= DATE '{fx.TODAY}' - 3 AND {_START} <= TIMESTAMP '{fx.NOW}' - INTERVAL 3 DAY"


@query(f"WITH {fx.CALENDAR} SELECT id, CASE WHEN {_DUE} THEN 'expired' ELSE status END AS status FROM cal")
def expire_due(spark, sf_dir):
    return store.expire_due(fx.calendar(spark, sf_dir), 3, fx.NOW).select("id", "status")


@query(f"WITH {fx.CALENDAR} SELECT id FROM cal WHERE NOT coalesce(status = 'expired' AND date < DATE '{fx.TODAY}' - 7, false)")
def purge_expired(spark, sf_dir):
    return store.purge_expired(fx.calendar(spark, sf_dir), 7, fx.TODAY).select("id")


@query(f"""WITH {fx.CALENDAR}, x AS (SELECT id, date, CASE WHEN {_DUE} THEN 'expired' ELSE status END AS status FROM cal)
SELECT id, status FROM x WHERE NOT coalesce(status = 'expired' AND date < DATE '{fx.TODAY}' - 7, false)""")
def cleanup(spark, sf_dir):
    return store.cleanup(fx.calendar(spark, sf_dir), 3, 7, fx.NOW).select("id", "status")


@query(f"""WITH {fx.CALENDAR} SELECT status, count(*) AS n, sum((date IS NULL)::INT)::BIGINT AS undated, strftime(min({_START}), '%Y-%m-%d %H:%M:%S') AS first_start,
strftime(max({_START}), '%Y-%m-%d %H:%M:%S') AS last_start FROM cal GROUP BY status""")
def event_starts(spark, sf_dir):
    start = schedule.event_start(F.col("date"), F.col("time"))
    out = fx.calendar(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("date").isNull()).alias("undated"), F.min(start).alias("first_start"), F.max(start).alias("last_start"))
    return _as_text(out)


_HASH = "sha256(trim(regexp_replace(regexp_replace(lower(event_title), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || '|' || coalesce(strftime(date, '%Y-%m-%d'), ''))"


_POSTED = "'c' || (id % 40)::VARCHAR AS channel, id % 900 AS message_id"


def _posts(spark, sf_dir, own_titles=False):
    """Posts of forty channels whose ids repeat, with events as titles and dates; a channel's titles may be its own."""
    channel = F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))
    title = F.concat(channel, F.lit(" "), "event_title") if own_titles else F.col("event_title")
    return fx.calendar(spark, sf_dir).select(channel.alias("channel"), (F.col("id") % 900).alias("message_id"), title.alias("event_title"), "date", "status", F.col("id").alias("ordinal"))


@query(f"""WITH RECURSIVE {fx.CALENDAR}, bat AS (SELECT {_POSTED}, 'c' || (id % 40)::VARCHAR || ' ' || event_title AS event_title, date, id AS ordinal FROM cal), s AS (
  SELECT *, {_HASH} AS h, row_number() OVER (PARTITION BY channel ORDER BY ordinal) AS k FROM bat
), f AS (
  SELECT channel, 0::BIGINT AS k, []::STRUCT(id BIGINT, m BIGINT, t VARCHAR, d DATE, h VARCHAR)[] AS st FROM (SELECT DISTINCT channel FROM s)
  UNION ALL
  SELECT f.channel, s.k, CASE
    WHEN list_contains(list_transform(f.st, lambda e: e.m), s.message_id)
      THEN list_transform(f.st, lambda e: CASE WHEN e.m = s.message_id THEN {{'id': e.id, 'm': s.message_id, 't': s.event_title, 'd': s.date, 'h': s.h}} ELSE e END)
    WHEN list_contains(list_transform(f.st, lambda e: e.h), s.h) THEN f.st
    ELSE list_append(f.st, {{'id': s.ordinal, 'm': s.message_id, 't': s.event_title, 'd': s.date, 'h': s.h}}) END
  FROM f JOIN s ON s.channel = f.channel AND s.k = f.k + 1
), z AS (SELECT channel, unnest(arg_max(st, k)) AS e FROM f GROUP BY channel)
SELECT channel, e.id AS id, e.m AS message_id, e.t AS event_title, strftime(e.d, '%Y-%m-%d') AS date, e.h AS content_hash FROM z""")
def upsert_fold(spark, sf_dir):
    """All posts, row by row: channels that keep their own titles never meet."""
    return _as_text(store.fold_batch(_posts(spark, sf_dir, own_titles=True), F.col("channel")))


@query(f"""WITH {fx.CALENDAR}, cur AS (
  SELECT {_POSTED}, event_title, date, {_HASH} AS content_hash, status, row_number() OVER (PARTITION BY 'c' || (id % 40)::VARCHAR, id % 900 ORDER BY id) AS k FROM cal WHERE id % 3 <> 0
), c AS (SELECT * FROM cur WHERE k = 1), b AS (
  SELECT {_POSTED}, event_title, date, id AS ordinal, {_HASH} AS content_hash FROM cal WHERE id % 3 = 0
  UNION ALL SELECT channel, message_id, event_title, date, 1000000000 + row_number() OVER (ORDER BY channel, message_id, k), content_hash FROM cur WHERE k > 1
), n AS (SELECT *, row_number() OVER (PARTITION BY channel, message_id ORDER BY ordinal DESC) AS n FROM b), l AS (
  SELECT n.*, EXISTS (SELECT 1 FROM c WHERE c.channel = n.channel AND c.message_id = n.message_id) AS ex, n.content_hash IN (SELECT content_hash FROM c) AS kn FROM n WHERE n = 1
), m AS (SELECT *, row_number() OVER (PARTITION BY content_hash, ex ORDER BY ordinal) AS f FROM l)
SELECT c.channel, c.message_id, coalesce(m.event_title, c.event_title) AS event_title, strftime(CASE WHEN m.channel IS NULL THEN c.date ELSE m.date END, '%Y-%m-%d') AS date,
       coalesce(m.content_hash, c.content_hash) AS content_hash, c.status
FROM c LEFT JOIN m ON m.ex AND m.channel = c.channel AND m.message_id = c.message_id
UNION ALL SELECT channel, message_id, event_title, strftime(date, '%Y-%m-%d'), content_hash, 'pending' FROM m WHERE NOT ex AND NOT kn AND f = 1""")
def upsert_merge(spark, sf_dir):
    """Two thirds of the posts are the table, the first of each key; the others, and what repeats a key, come as one batch."""
    posts = _posts(spark, sf_dir)
    w = Window.partitionBy("channel", "message_id").orderBy("ordinal")
    before = posts.where("ordinal % 3 <> 0").withColumn("k", F.row_number().over(w))
    hashed = texts.content_hash(F.col("event_title"), F.col("date")).alias("content_hash")
    current = before.where("k = 1").select("channel", "message_id", "event_title", "date", hashed, "status")
    # Repeats come after all others, by channel, message and turn: the last turn of a key counts.
    columns = ["channel", "message_id", "event_title", "date", "ordinal"]
    again = before.where("k > 1").withColumn("ordinal", F.col("ordinal") + 1_000_000_000).select(*columns)
    return _as_text(store.merge_batch(current, posts.where("ordinal % 3 = 0").select(*columns).unionByName(again)))


@query(f"""WITH {fx.CALENDAR} SELECT id, CASE WHEN id % 6 = 0 THEN 'new ' || event_title ELSE event_title END AS event_title,
strftime(CASE WHEN id % 6 = 2 THEN NULL WHEN id % 6 = 4 THEN DATE '2024-02-01' ELSE date END, '%Y-%m-%d') AS date FROM cal""")
def patch_edit(spark, sf_dir):
    events = fx.calendar(spark, sf_dir)
    key = F.when(F.col("id") % 6 == 0, F.create_map(F.lit("event_title"), F.concat(F.lit("new "), "event_title")))
    key = key.when(F.col("id") % 6 == 2, F.create_map(F.lit("date"), F.lit(None).cast("string"), F.lit("event_title"), F.lit(None).cast("string")))
    key = key.when(F.col("id") % 6 == 4, F.create_map(F.lit("date"), F.lit("2024-02-01")))
    patches = events.where("id % 2 = 0").select("id", key.alias("patch"))
    return _as_text(store.patched(events, patches).select("id", "event_title", "date"))


@query(f"""WITH {fx.CALENDAR} SELECT id, event_title AS title, concat_ws(', ', coalesce(strftime(date, '%Y-%m-%d'), 'дата уточнюється'), time, CASE id % 4 WHEN 0 THEN 'hall ' || (id % 9)::VARCHAR END) AS body
FROM cal WHERE status = 'pending' AND id % 3 = 0 AND date >= DATE '{fx.TODAY}'""")
def approve_notify(spark, sf_dir):
    n = F.col("id")
    events = fx.calendar(spark, sf_dir).withColumn("location", F.when(n % 4 == 0, F.concat(F.lit("hall "), (n % 9).cast("string"))).when(n % 4 == 1, ""))
    return store.notifications(events, (F.col("status") == "pending") & (F.col("id") % 3 == 0), fx.TODAY)


# The queue


@query(f"WITH {fx.JOBS} SELECT id, 'processing' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'queued' AND available_at <= TIMESTAMP '{fx.NOW}' ORDER BY id LIMIT 250")
def claim_batch(spark, sf_dir):
    return jobs.claim(fx.jobs(spark, sf_dir), 250, fx.NOW).select("id", "status", "attempts")


_FMT = "'%Y-%m-%d %H:%M:%S'"


@query(f"""WITH {fx.JOBS} SELECT id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, strftime(CASE WHEN attempts >= 3 THEN available_at ELSE TIMESTAMP '{fx.NOW}' END, {_FMT}) AS available_at,
CASE WHEN attempts >= 3 THEN strftime(TIMESTAMP '{fx.NOW}', {_FMT}) END AS finished_at, CASE WHEN attempts >= 3 THEN '{jobs.LOST}' ELSE '{jobs.REQUEUED}' END AS last_error, true AS free
FROM jobs WHERE status = 'processing' AND locked_at < TIMESTAMP '{fx.NOW}' - INTERVAL 600 SECOND""")
def requeue_stale(spark, sf_dir):
    out = jobs.requeue_stale(fx.jobs(spark, sf_dir), 600, 3, fx.NOW)
    return _as_text(out.select("id", "status", "available_at", "finished_at", "last_error", (F.col("locked_at").isNull() & F.col("locked_by").isNull()).alias("free")))


@query(f"""WITH {fx.JOBS} SELECT id, CASE WHEN d THEN 'done' ELSE status END AS status, CASE WHEN d THEN strftime(TIMESTAMP '{fx.NOW}', {_FMT}) WHEN id % 4 = 2 THEN strftime(available_at, {_FMT}) END AS finished_at,
CASE WHEN NOT d THEN 'old' END AS last_error, CASE WHEN NOT d THEN strftime(locked_at, {_FMT}) END AS locked_at FROM (SELECT *, status = 'processing' AND id % 8 = 1 AS d FROM jobs)""")
def mark_done(spark, sf_dir):
    table = fx.jobs(spark, sf_dir).withColumns({"finished_at": F.when(F.col("id") % 4 == 2, F.col("available_at")), "last_error": F.lit("old")})
    done = jobs.mark_done(table, (F.col("status") == "processing") & (F.col("id") % 8 == 1), fx.NOW)
    return _as_text(done.select("id", "status", "finished_at", "last_error", "locked_at"))


@query(f"""WITH {fx.JOBS} SELECT id, CASE WHEN attempts >= 4 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts >= 4 THEN strftime(TIMESTAMP '{fx.NOW}', {_FMT}) END AS finished_at, NULL::VARCHAR AS locked_at,
strftime(CASE WHEN attempts >= 4 THEN available_at ELSE TIMESTAMP '{fx.NOW}' + to_seconds(30 * (2 ** greatest(attempts - 1, 0))::INT) END, {_FMT}) AS available_at
FROM jobs WHERE status = 'processing'""")
def fail_backoff(spark, sf_dir):
    running = fx.jobs(spark, sf_dir).where("status = 'processing'")
    return _as_text(jobs.mark_failed(running, F.lit("timeout"), 30, 4, fx.NOW).select("id", "status", "available_at", "finished_at", "locked_at"))


@query(f"WITH {fx.JOBS} SELECT id, 'queued' AS status, greatest(attempts - 1, 0) AS attempts, strftime(TIMESTAMP '{fx.NOW}', {_FMT}) AS available_at FROM jobs WHERE status = 'processing'")
def release(spark, sf_dir):
    return _as_text(jobs.release(fx.jobs(spark, sf_dir).where("status = 'processing'"), fx.NOW).select("id", "status", "attempts", "available_at"))


@query(f"WITH {fx.JOBS} SELECT id FROM jobs WHERE status = 'queued' AND attempts > 0 AND available_at <= TIMESTAMP '{fx.NOW}'")
def retry_due(spark, sf_dir):
    return jobs.due_again(fx.jobs(spark, sf_dir), fx.NOW).select("id")


@query(f"""WITH {fx.JOBS}, m AS (SELECT id, channel, message_id FROM jobs WHERE id % 7 = 3)
SELECT id FROM m WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status IN ('queued', 'processing') AND j.channel = m.channel AND j.message_id = m.message_id AND j.id % 7 <> 3)""")
def enqueue_anti(spark, sf_dir):
    table = fx.jobs(spark, sf_dir)
    return jobs.enqueue(table.where("id % 7 <> 3"), table.where("id % 7 = 3").select("id", "channel", "message_id")).select("id")


@query(f"WITH {fx.JOBS} SELECT channel, message_id, max(id) AS job_id FROM jobs WHERE status IN ('queued', 'processing') GROUP BY ALL")
def latest_active_job(spark, sf_dir):
    return jobs.latest_active(fx.jobs(spark, sf_dir))


@query(f"""WITH {fx.JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done,
count(*) FILTER (status = 'failed') AS failed, round_even(avg(duration_ms) FILTER (status = 'done'), 0)::BIGINT AS avg_ms, (max(duration_ms) FILTER (status = 'done'))::BIGINT AS max_ms,
count(duration_ms) FILTER (status = 'done') AS timed FROM jobs""")
def queue_stats(spark, sf_dir):
    return jobs.queue_stats(fx.jobs(spark, sf_dir))


@query(f"WITH {fx.JOBS} SELECT id, attempts FROM jobs WHERE status = 'failed' ORDER BY id DESC LIMIT 75")
def jobs_list(spark, sf_dir):
    return jobs.recent(fx.jobs(spark, sf_dir), 75, "failed").select("id", "attempts")


# Deduplication


@query(f"WITH {fx.CALENDAR} SELECT id, {_HASH} AS content_hash FROM cal")
def content_hash(spark, sf_dir):
    return fx.calendar(spark, sf_dir).select("id", texts.content_hash(F.col("event_title"), F.col("date")).alias("content_hash"))


_TITLES = [
    ("Лекція №5", "лекція no5", "лекція no5"), ("Ⅷ Олімпіада", "viii олімпіада", "viii олімпіада"), ("Straße", "strasse", "strasse"), ("Ｚｏｏｍ  МИТЬ", "zoom мить", "zoom мить"),
    ("«Відкрита» лекція, 2-го курсу!", "відкрита лекція 2 го курсу", "«відкрита» лекція, 2 курсу!"), ("ПʼЯТНИЦЯ 15 – 16", "п ятниця 15 16", "п'ятниця 15-16"), ("", "", ""), ("½ ﬁn² …", "1 2 fin2", "1⁄2 fin2 ..."),
]


@query(f"""WITH t(case_no, title, normal, value_form) AS (VALUES {", ".join(f"({i}, '" + "', '".join(x.replace("'", "''") for x in r) + "')" for i, r in enumerate(_TITLES))})
SELECT doc_id, title || ' ' || lang AS title, ltrim(normal || ' ' || lang) AS normal, ltrim(value_form || ' ' || lang) AS value_form, sha256(ltrim(replace(normal, 'п ятниця', 'пʼятниця') || ' ' || lang) || '|2026-11-02') AS content_hash
FROM documents JOIN t ON doc_id % {len(_TITLES)} = case_no""")
def title_forms(spark, sf_dir):
    """Letters that fold to others: the hash and the normal form of values."""
    t = F.col("title")
    rows = _cases(spark, sf_dir, [(r[0],) for r in _TITLES], "title string").join(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("title", F.concat("title", F.lit(" "), "lang"))
    return rows.select("doc_id", "title", F.regexp_replace(texts.normalize_title(t), "ʼ", " ").alias("normal"), texts.norm(t).alias("value_form"), texts.content_hash(t, F.lit(_MONDAY).cast("date")).alias("content_hash"))


@query(f"WITH {fx.CALENDAR}, x AS (SELECT *, row_number() OVER (PARTITION BY id // 50, lower(trim(event_title)), date ORDER BY id) AS k FROM cal) SELECT id FROM x WHERE k = 1")
def dedup_in_message(spark, sf_dir):
    keyed = fx.calendar(spark, sf_dir).withColumns({"message_id": F.floor(F.col("id") / 50), "key": F.lower(F.trim("event_title"))})
    return jobs.first_per(keyed, ["message_id", "key", "date"], ["id"]).select("id")


def _fates(spark, sf_dir):
    n = F.col("id")
    return fx.calendar(spark, sf_dir).select(
        F.floor(n / 50).alias("index"), n.alias("ordinal"), "date", texts.content_hash(F.col("event_title"), F.col("date")).alias("content_hash"),
        (n % 6 != 5).alias("is_candidate"), (n % 19 == 1).alias("is_foreign"), (n % 23 == 2).alias("is_individual"),
        F.coalesce(F.col("date") < F.lit("2024-01-04").cast("date"), F.lit(False)).alias("is_stale"),
    )


_FATES = f"""g AS (
  SELECT id, date, {_HASH} AS h, CASE WHEN id % 6 = 5 THEN 'filtered' WHEN id % 19 = 1 THEN 'language' WHEN id % 23 = 2 THEN 'individual' WHEN date < DATE '2024-01-04' THEN 'stale' END AS gate FROM cal
), d AS (SELECT id, date, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY h, gate IS NULL ORDER BY id // 50, id) = 1 THEN 'saved' ELSE 'duplicate' END) AS fate FROM g)"""


@query(f"WITH {fx.CALENDAR}, {_FATES} SELECT id AS ordinal, fate, CASE WHEN fate = 'saved' THEN CASE WHEN date IS NULL THEN 'no_date' ELSE 'feed' END END AS feed FROM d")
def dedup_cross_run(spark, sf_dir):
    return reports.destinies(_fates(spark, sf_dir)).select("ordinal", "fate", "feed")


@query(f"""WITH {fx.CALENDAR}, {_FATES} SELECT count(*) FILTER (fate = 'saved') AS saved, count(*) FILTER (fate = 'duplicate') AS duplicate, count(*) FILTER (fate = 'filtered') AS filtered,
count(*) FILTER (fate = 'individual') AS individual, count(*) FILTER (fate = 'stale') AS stale, count(*) FILTER (fate = 'language') AS language, count(*) FILTER (fate = 'saved' AND date IS NOT NULL) AS feed FROM d""")
def destiny_summary(spark, sf_dir):
    return reports.summarize_destinies(reports.destinies(_fates(spark, sf_dir)))


@query("""WITH s AS (SELECT user_id AS message_id, (event_id * 7) % 400 AS a, (event_id * 7) % 400 + 3 + event_id % 11 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY message_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY message_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT message_id, min(a) AS start, max(b) AS "end" FROM i GROUP BY message_id, k""")
def merge_spans(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    start = (F.col("event_id") * 7) % 400
    return reports.merge_spans(e.select(F.col("user_id").alias("message_id"), start.alias("start"), (start + 3 + F.col("event_id") % 11).alias("end")), ["message_id"])


# Rule gates, with dictionaries of the fixtures' languages


_WORDS = ["the", "that", "with", "être", "dans", "der", "und", "para"]
_HITS = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in _WORDS)
_CLOCK = r"(^|[^\p{L}\p{N}_])([01]?[0-9]|2[0-3])[:.][0-5][0-9]($|[^\p{L}\p{N}_])"


@query(rf"""WITH {fx.MESSAGES}, s AS (SELECT message_id, ({_HITS})::DOUBLE + CASE WHEN regexp_matches(text, '{_CLOCK}') THEN 1.0 ELSE 0.0 END
+ CASE WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])[0-9]{{1,2}}[./][0-9]{{1,2}}([./][0-9]{{2,4}})?($|[^\p{{L}}\p{{N}}_])') THEN 1.0 ELSE 0.0 END AS v, text FROM msg)
SELECT message_id, CASE WHEN coalesce(trim(text), '') = '' THEN 0.0 ELSE v END AS score, coalesce(trim(text), '') <> '' AND v >= 3 AS candidate FROM s""")
def prefilter_score(spark, sf_dir):
    scored = fx.messages(spark, sf_dir).select("message_id", "text", rules.prefilter_score(F.col("text"), _WORDS).alias("score"))
    return scored.select("message_id", "score", ((F.coalesce(F.trim("text"), F.lit("")) != "") & (F.col("score") >= 3.0)).alias("candidate"))


_LEFT, _RIGHT = "éèêç", "äöüß"
_EN, _ES = ["the", "that", "with", "to"], ["para", "que", "con", "los", "to"]


@query(rf"""WITH {fx.MESSAGES}, x AS (SELECT message_id, lower(text) AS t, length(text) - length(translate(lower(text), '{_LEFT}', '')) AS a, length(text) - length(translate(lower(text), '{_RIGHT}', '')) AS b FROM msg),
w AS (SELECT message_id, count(DISTINCT w) FILTER (w IN ('the', 'that', 'with')) AS e, count(DISTINCT w) FILTER (w IN ('para', 'que', 'con', 'los')) AS s FROM (SELECT message_id, unnest(regexp_extract_all(t, '\p{{L}}+')) AS w FROM x) GROUP BY 1)
SELECT x.message_id, CASE WHEN a + b > 0 THEN CASE WHEN a >= b THEN 'fr' ELSE 'de' END WHEN e > s THEN 'fr' WHEN s > e THEN 'de' END AS language FROM x LEFT JOIN w USING (message_id)""")
def lang_letters(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("message_id", rules.detect_language(F.col("text"), (_LEFT, _RIGHT), (_EN, _ES), ("fr", "de")).alias("language"))


_ONE, _MANY = [("ing\\s+the", "ing the"), ("tion\\s+of", "tion of")], [("the\\s+and", "the and"), ("of\\s+the", "of the")]


@query(rf"""WITH {fx.MESSAGES}, x AS (SELECT message_id, regexp_matches(text, 'ing\s+the', 'i') AS a, regexp_matches(text, 'tion\s+of', 'i') AS b, regexp_matches(text, 'the\s+and', 'i') AS c, regexp_matches(text, 'of\s+the', 'i') AS d FROM msg)
SELECT message_id, CASE WHEN (a OR b) AND NOT (c OR d) THEN 'individual' WHEN a OR b THEN 'group' ELSE 'public' END AS scope, a::INT + b::INT AS n_individual, c::INT + d::INT AS n_collective FROM x""")
def scope_markers(spark, sf_dir):
    verdict = fx.messages(spark, sf_dir).select("message_id", rules.classify_scope(F.coalesce("text", F.lit("")), _ONE, _MANY).alias("v"))
    return verdict.select("message_id", "v.scope", F.size("v.individual").alias("n_individual"), F.size("v.collective").alias("n_collective"))


@query(f"""WITH {fx.CALENDAR} SELECT id, CASE WHEN date < DATE '{fx.TODAY}' THEN 'подія вже відбулася: ' || strftime(date, '%Y-%m-%d') || ' — на ' || (DATE '{fx.TODAY}' - date)::VARCHAR || ' дн. раніше за оголошення ({fx.TODAY})' END AS reason FROM cal""")
def stale_by_date(spark, sf_dir):
    return fx.calendar(spark, sf_dir).select("id", rules.past_date_reason(F.col("date"), F.lit(fx.TODAY).cast("date")).alias("reason"))


# The same rules with their own dictionaries: literal cases and what they must give


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _cell(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def _cases(spark, sf_dir, rows, schema):
    """Every document with one of the cases, in turn by its id."""
    cases = _values(spark, [(i, *r) for i, r in enumerate(rows)], f"__case long, {schema}")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(rows)).alias("__case"))
    return docs.join(F.broadcast(cases), "__case").drop("__case")


def _golden(columns: str, rows: list[tuple], n: int | None = None) -> str:
    """What the cases must give, for every document; where a case gives no row or several, its number comes first and ``n`` is
    how many cases there are."""
    numbered = rows if n else [(i, *r) for i, r in enumerate(rows)]
    values = ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in numbered)
    return f"SELECT doc_id, {columns} FROM (SELECT doc_id FROM documents) JOIN (VALUES {values}) t(case_no, {columns}) ON doc_id % {n or len(rows)} = case_no"


#: Weeks by which a document's clock is ahead, so that days of the week are the same.
_WEEKS_SQL = "7 * (doc_id % 40)::INT"


def _ahead(day: str):
    return F.date_add(F.lit(day).cast("date"), (7 * (F.col("doc_id") % 40)).cast("int"))


_MONDAY = "2026-11-02"
_RELATIVE = [
    ("лекція у п'ятницю", "2026-11-06"), ("наступної п'ятниці семінар", "2026-11-13"), ("у понеділок іспит", "2026-11-09"), ("післязавтра зустріч", "2026-11-04"),
    ("вчора завершився X, завтра починається Y", None), ("через два тижні", "2026-11-16"), ("у п’ятницю", None), ("через 3 дні залік", "2026-11-05"),
    ("позавчора", "2026-10-31"), ("без дати", None),
]


@query(_golden("text, date", _RELATIVE).replace("text, date FROM", f"text, strftime(date::DATE + {_WEEKS_SQL}, '%Y-%m-%d') AS date FROM"))
def uk_schedule(spark, sf_dir):
    rows = _cases(spark, sf_dir, [(t,) for t, _ in _RELATIVE], "text string")
    return rows.select("doc_id", "text", schedule.resolve_relative_date(F.col("text"), _ahead(_MONDAY)).cast("string").alias("date"))


_TIMES = [("11:00-16:00", "11:00"), ("9:5", None), ("11.00", None), ("9:05", "09:05"), ("24:00", None), ("11.00 – 16.00", "11:00"), (" 8:30 ", "08:30")]


@query(_golden("value, time", _TIMES))
def uk_time(spark, sf_dir):
    return _cases(spark, sf_dir, [(t,) for t, _ in _TIMES], "value string").select("doc_id", "value", schedule.normalize_time(F.col("value")).alias("time"))


_MEETINGS = [
    ("Підключення: https://a.ua/x). Код доступу 316742", "https://a.ua/x", "код 316742", None),
    ("Zoom, ідентифікатор конференції 845 2371 9004, пароль: ab12cd", None, "ID 845 2371 9004 · код ab12cd", "Zoom"),
    ("див. www.knu.ua. Google Meet", "https://www.knu.ua", None, "Google Meet"), ("немає нічого", None, None, None),
]


@query(_golden("text, link, code, platform", _MEETINGS))
def uk_meeting(spark, sf_dir):
    t = F.col("text")
    rows = _cases(spark, sf_dir, [(r[0],) for r in _MEETINGS], "text string")
    return rows.select("doc_id", "text", meeting.repaired_link(F.lit(None).cast("string"), t).alias("link"), meeting.find_meeting_code(t).alias("code"), meeting.detect_platform(t).alias("platform"))


_STALE = [
    ("Семінар скасовано.", "подію скасовано, нової дати немає: «скасовано»"), ("Семінар скасовано, новий 5 грудня", None),
    ("Вчора успішно завершилася конференція.", "звіт про минуле, а не анонс: «Вчора успішно завершилася»"), ("Дякуємо всім, хто прийшов", "звіт про минуле, а не анонс: «Дякуємо всім, хто»"),
    ("Вийшов друком збірник тез", "анонс публікації, а не подія: «Вийшов друком»"), ("Лекція завтра", None),
]


@query(_golden("text, reason", _STALE))
def uk_stale(spark, sf_dir):
    rows = _cases(spark, sf_dir, [(t,) for t, _ in _STALE], "text string")
    return rows.select("doc_id", "text", rules.stale_reason(F.col("text"), F.lit(None).cast("date"), F.lit(_MONDAY).cast("date")).alias("reason"))


_SCOPES = [
    ("консультації за попереднім записом", "individual", "персональний формат: за попереднім записом"),
    ("консультація для всіх за попереднім записом", "group", "є ознаки персонального (за попереднім записом), але й масового (для всіх) — лишаємо"),
    ("Відкрита лекція", "public", "масовий захід: відкрита лекція"), ("Семінар", "public", "ознак персонального формату немає"),
]


@query(_golden("text, scope, reason", _SCOPES))
def uk_scope(spark, sf_dir):
    return _cases(spark, sf_dir, [(r[0],) for r in _SCOPES], "text string").select("doc_id", "text", rules.classify_scope(F.col("text")).alias("v")).select("doc_id", "text", "v.scope", "v.reason")


_LANGUAGES = [("скоро відкриття: регистрация закрыта, ждём", "ru"), ("їжа та объект", "uk"), ("приглашаем всех", "ru"), ("друзі", "uk"), ("сегодня", None), ("hello", None), ("дуже добре", "uk")]


@query(_golden("text, language", _LANGUAGES))
def uk_language(spark, sf_dir):
    return _cases(spark, sf_dir, [(t,) for t, _ in _LANGUAGES], "text string").select("doc_id", "text", rules.detect_language(F.col("text")).alias("language"))


_PREFILTERED = [("Гарних вихідних усім! 🌞", 0.0), ("Запрошуємо на лекцію 12.05 о 14:30", 5.0), ("завтра", 0.5), ("наступного тижня", 0.0), ("", 0.0), ("Дедлайн 3 квітня", 2.0)]


@query(_golden("text, score", _PREFILTERED).replace("text, score FROM", "text, score::DOUBLE AS score FROM"))
def uk_prefilter(spark, sf_dir):
    return _cases(spark, sf_dir, [(t,) for t, _ in _PREFILTERED], "text string").select("doc_id", "text", rules.prefilter_score(F.col("text")).alias("score"))


_DATES = [
    ("2026-11-15", "15-16 листопада", "ok"), ("2026-11-16", "з 15 по 16 листопада", "ok"), ("2026-11-17", "15.11 о 10:00", "invented"), ("2026-11-03", "завтра", "ok"),
    ("2026-11-04", "післязавтра", "invented"), ("2026-11-06", "у п'ятницю", "ok"), ("2026-11-06", "без дати", "invented"), ("2026-11-15", "15 листопада 2025", "suspect"),
]


@query(_golden("date, text, status", _DATES))
def uk_date_grounding(spark, sf_dir):
    rows = _cases(spark, sf_dir, [r[:2] for r in _DATES], "date string, text string")
    return rows.select("doc_id", "date", "text", grounding.date_status(F.col("date").cast("date"), F.col("text"), F.lit(_MONDAY).cast("date")).alias("status"))


_FOUND = [
    ("аудиторія 405", "в ауд. 406", "invented"), ("корпус 3", "у аудиторії третього корпусу", "ok"), ("відкриття виставки", "відкриття завтра", "suspect"), ("12", "о 12 годині", "ok"),
]


@query(_golden("value, source, status", _FOUND))
def uk_text_grounding(spark, sf_dir):
    rows = _cases(spark, sf_dir, [r[:2] for r in _FOUND], "value string, source string")
    return rows.select("doc_id", "value", "source", grounding.text_status(F.col("value"), F.col("source")).alias("status"))


_KINDS = [("ПАСТКА: реклама", "trap"), (" індивідуальна консультація", "individual"), ("подія", "announcement"), (None, "announcement")]


@query(_golden("note, kind", _KINDS))
def message_kinds(spark, sf_dir):
    return _cases(spark, sf_dir, [(n,) for n, _ in _KINDS], "note string").select("doc_id", "note", reports.message_kind(F.col("note")).alias("kind"))


@query(f"""WITH {fx.MESSAGES} SELECT message_id, md5('Reference date: ' || strftime(ref_date, '%Y-%m-%d') || ' (' || dayname(ref_date) || ')' || chr(10) || 'Message: "' || text || '"') AS prompt FROM msg""")
def user_messages(spark, sf_dir):
    from eventloom.plans.extract import user_message

    return fx.messages(spark, sf_dir).select("message_id", F.md5(F.encode(user_message(F.col("text"), F.col("ref_date")), "utf-8")).alias("prompt"))


@query(f"WITH {fx.MESSAGES} SELECT message_id FROM msg WHERE lower(channel) IN ('@src1', '@src7')")
def allowed_channels(spark, sf_dir):
    return fx.messages(spark, sf_dir).where(rules.channel_allowed(F.col("channel"), ["@SRC1", "@src7"])).select("message_id")


@query(f"WITH {fx.MESSAGES} SELECT message_id, channel FROM (SELECT * FROM msg ORDER BY message_id DESC LIMIT 60)")
def last_history(spark, sf_dir):
    from eventloom.sources.messages import last_messages

    return last_messages(fx.messages(spark, sf_dir), 60).select("message_id", "channel")


@query(f"""WITH {fx.CALENDAR} SELECT id, event_title || chr(10) || coalesce(strftime(date, '%Y-%m-%d'), '—') || ' ' || coalesce(time, '—') || chr(10) || '—' AS card FROM cal""")
def moderation_cards(spark, sf_dir):
    from eventloom.sources.sinks import card

    return fx.calendar(spark, sf_dir).select("id", card(F.col("event_title"), F.col("date"), F.col("time"), F.lit(None).cast("string")).alias("card"))


# Links, times, dates


_URLS = r"regexp_extract_all(text, 'https?://[^\s<>\"''()\[\],]+')"


@query(rf"""WITH {fx.LINKS} SELECT page_id, list_transform({_URLS}, lambda u: rtrim(u, '.,;:!?)»"''')) AS urls FROM lnk""")
def find_urls(spark, sf_dir):
    return fx.links(spark, sf_dir).select("page_id", meeting.find_urls(F.col("text")).alias("urls"))


@query(f"WITH {fx.LINKS} SELECT page_id, nullif(rtrim(trim(' ' || url || ').'), '/.,;)'), '') AS link FROM lnk")
def normalize_link(spark, sf_dir):
    return fx.links(spark, sf_dir).select("page_id", meeting.normalize_link(F.concat(F.lit(" "), "url", F.lit(")."))).alias("link"))


@query(f"""WITH {fx.LINKS} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missed' WHEN 2 THEN 'invented' ELSE 'suspect' END AS status FROM lnk""")
def check_link(spark, sf_dir):
    k = F.col("page_id") % 4
    said = F.when(k == 0, F.col("url")).when(k == 2, F.lit("https://elsewhere.test/x")).when(k == 3, F.concat("url", F.lit("extra")))
    return fx.links(spark, sf_dir).select("page_id", grounding.link_status(said, F.col("text")).alias("status"))


@query(f"WITH {fx.CALENDAR} SELECT id, CASE WHEN time <> '25:99' THEN time END AS time FROM cal")
def normalize_time(spark, sf_dir):
    return fx.calendar(spark, sf_dir).select("id", schedule.normalize_time(F.concat(F.lit(" "), "time", F.lit("-23:59"))).alias("time"))


@query(f"WITH {fx.CALENDAR} SELECT id, strftime(date + (CASE WHEN (4 - (isodow(date) - 1) + 7) % 7 = 0 THEN 7 ELSE (4 - (isodow(date) - 1) + 7) % 7 END)::INT, '%Y-%m-%d') AS friday FROM cal")
def relative_weekday(spark, sf_dir):
    return fx.calendar(spark, sf_dir).select("id", schedule.next_weekday(F.col("date"), 4).cast("string").alias("friday"))


# Scores against gold data


def _keys_sql(field: str, value: str) -> str:
    """Each group of keys has an alternative in the value."""
    return f"list_bool_and(list_transform(g.{field}_keys, lambda grp: list_bool_or(list_transform(grp, lambda alt: contains({value}, alt)))))"


_CLOCK_SQL = "lpad(regexp_extract(p.time, '([0-9]{1,2}):([0-9]{2})', 1), 2, '0') || ':' || regexp_extract(p.time, '([0-9]{1,2}):([0-9]{2})', 2)"
_MATCH = {
    **{f: _keys_sql(f, f"lower(p.{f})") for f in scoring.KEY_FIELDS}, "date": "trim(p.date) = g.date", "time": f"{_CLOCK_SQL} = g.time",
    "event_type": "(trim(p.event_type) = g.event_type OR list_contains(g.event_type_accept, trim(p.event_type)))", "description": "true", "language": "trim(p.language) = g.language",
    "link": "rtrim(trim(p.link), '/.,;)') IS NOT DISTINCT FROM rtrim(trim(g.link), '/.,;)')", "meeting_code": _keys_sql("meeting_code", "replace(lower(p.meeting_code), ' ', '')"),
}


def _aligned_sql(pred: str = "pred") -> str:
    """al_<pred>: the chosen pairs of gold and that table."""
    return f"""cand_{pred} AS (
  SELECT g.message_id, g.gold_idx AS gi, p.pred_idx AS pi, coalesce(CASE WHEN {_MATCH["date"]} THEN 3 END, 0) + coalesce(CASE WHEN p.event_title IS NOT NULL AND {_MATCH["event_title"]} THEN 2 END, 0)
         + coalesce(CASE WHEN {_MATCH["time"]} THEN 1 END, 0) AS score
  FROM gold g JOIN {pred} p USING (message_id)
), c_{pred} AS (SELECT * FROM cand_{pred} WHERE score >= 2),
r_{pred} AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, gi, pi) AS k FROM c_{pred}),
a_{pred} AS (
  SELECT message_id, 0::BIGINT AS k, []::INT[] AS ug, []::INT[] AS up, []::STRUCT(gi INT, pi INT, score INT)[] AS ps FROM (SELECT DISTINCT message_id FROM r_{pred})
  UNION ALL
  SELECT a.message_id, r.k, CASE WHEN u THEN a.ug ELSE list_append(a.ug, r.gi) END, CASE WHEN u THEN a.up ELSE list_append(a.up, r.pi) END,
         CASE WHEN u THEN a.ps ELSE list_append(a.ps, {{'gi': r.gi, 'pi': r.pi, 'score': r.score}}) END
  FROM a_{pred} a JOIN (SELECT * FROM r_{pred}) r ON r.message_id = a.message_id AND r.k = a.k + 1, LATERAL (SELECT list_contains(a.ug, r.gi) OR list_contains(a.up, r.pi) AS u)
), al_{pred} AS (SELECT message_id, x.gi AS gi, x.pi AS pi, x.score AS score FROM (SELECT message_id, unnest(arg_max(ps, k)) AS x FROM a_{pred} GROUP BY message_id))"""


def _cells_sql(pred: str = "pred") -> str:
    """fs_<pred>: a row for each field of each pair."""
    cells = " UNION ALL ".join(
        f"""SELECT al.message_id, al.gi, '{f}' AS field, g.{f} IS NULL AS gold_null, g.{f} AS gold_value, p.{f} AS said,
    CASE WHEN g.{f} IS NULL AND p.{f} IS NULL THEN 'correct' WHEN g.{f} IS NULL THEN 'fabricated' WHEN p.{f} IS NULL THEN 'missed'
         WHEN {m} THEN {"CASE WHEN g.inferred THEN 'invented_ok' ELSE 'correct' END" if f == "date" else "'correct'"} ELSE 'wrong' END AS category
    FROM al_{pred} al JOIN gold g ON g.message_id = al.message_id AND g.gold_idx = al.gi JOIN {pred} p ON p.message_id = al.message_id AND p.pred_idx = al.pi"""
        for f, m in ((f, _MATCH[f]) for f in FIELDS)
    )
    return f"fs_{pred} AS ({cells})"


def _counted_sql(pred: str = "pred") -> str:
    """ct_<pred>: the counters of each message."""
    summed = [*scoring.CATEGORIES, "correct_null", "paired_fields", "paired_gold_null", "paired_gold_nonnull"]
    return f"""ng_{pred} AS (SELECT message_id, count(*) AS n_gold FROM gold GROUP BY 1), np_{pred} AS (SELECT message_id, count(*) AS n_pred FROM {pred} GROUP BY 1),
na_{pred} AS (SELECT message_id, count(*) AS n_pair FROM al_{pred} GROUP BY 1),
nf_{pred} AS (SELECT message_id, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in scoring.CATEGORIES)}, count(*) FILTER (category = 'correct' AND gold_null) AS correct_null,
  count(*) AS paired_fields, count(*) FILTER (gold_null) AS paired_gold_null, count(*) FILTER (NOT gold_null) AS paired_gold_nonnull FROM fs_{pred} GROUP BY 1),
b_{pred} AS (SELECT s.message_id, kind, failed, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_pair, 0) AS n_pair,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in summed)}, kind = 'announcement' AS an, kind = 'announcement' AND coalesce(n_gold, 0) > 1 AS mu
  FROM scored s LEFT JOIN ng_{pred} USING (message_id) LEFT JOIN np_{pred} USING (message_id) LEFT JOIN na_{pred} USING (message_id) LEFT JOIN nf_{pred} USING (message_id)),
ct_{pred} AS (SELECT message_id, kind, {", ".join(f"CASE WHEN an THEN {c} ELSE 0 END AS {c}" for c in summed)},
  CASE WHEN an THEN (n_gold - n_pair) * {len(FIELDS)} ELSE 0 END AS missed_event_fields, CASE WHEN an THEN n_gold * {len(FIELDS)} ELSE 0 END AS gold_fields_total,
  an::BIGINT AS announcements, (an AND n_pair > 0)::BIGINT AS announcements_detected, (kind = 'trap')::BIGINT AS traps, (kind = 'trap' AND n_pred = 0 AND NOT failed)::BIGINT AS traps_clean,
  CASE WHEN kind = 'trap' THEN n_pred ELSE 0 END AS trap_false_events, (kind = 'individual')::BIGINT AS individual, (kind = 'individual' AND n_pred > 0)::BIGINT AS individual_extracted,
  0::BIGINT AS individual_dropped, mu::BIGINT AS multi, (mu AND n_gold = n_pair)::BIGINT AS multi_all_paired, (mu AND n_pred < n_gold AND n_pred > 0 AND n_pred = n_pair)::BIGINT AS multi_merged,
  CASE WHEN an THEN n_pred - n_pair ELSE 0 END AS extra_events, CASE WHEN an THEN n_gold - n_pair ELSE 0 END AS missed_events, failed::BIGINT AS errors, 1::BIGINT AS messages FROM b_{pred})"""


_PAIRS = f"{fx.GOLD}, {fx.predicted_sql()}, {fx.SCORED}, {_aligned_sql()}"
_SCORES = f"{_PAIRS}, {_cells_sql()}"
_COUNT = f"{_SCORES}, {_counted_sql()}"


def _scored(spark, sf_dir, shift=7):
    return scoring.judged(fx.scored_orders(spark, sf_dir, {"": shift}))


def _counters(spark, sf_dir, shift=7):
    return scoring.message_counters(_scored(spark, sf_dir, shift))


@query(f"WITH RECURSIVE {_PAIRS} SELECT message_id, gi, pi, score FROM c_pred")
def pair_score(spark, sf_dir):
    return scoring.candidates(_scored(spark, sf_dir))


@query(f"WITH RECURSIVE {_PAIRS} SELECT * FROM al_pred")
def align_greedy(spark, sf_dir):
    return scoring.align(_scored(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PAIRS}
SELECT al.message_id, kind, 'paired' AS status, gi, pi, al.score, g.event_title AS gold_title, p.event_title AS pred_title
FROM al_pred al JOIN gold g ON g.message_id = al.message_id AND g.gold_idx = gi JOIN pred p ON p.message_id = al.message_id AND p.pred_idx = pi JOIN scored s ON s.message_id = al.message_id
UNION ALL SELECT g.message_id, kind, 'missed_event', gold_idx, NULL, 0, g.event_title, '' FROM gold g JOIN scored USING (message_id) WHERE NOT EXISTS (SELECT 1 FROM al_pred al WHERE al.message_id = g.message_id AND al.gi = g.gold_idx)
UNION ALL SELECT p.message_id, kind, CASE kind WHEN 'trap' THEN 'false_event' ELSE 'extra_event' END, NULL, pred_idx, 0, '', p.event_title FROM pred p JOIN scored USING (message_id)
WHERE NOT EXISTS (SELECT 1 FROM al_pred al WHERE al.message_id = p.message_id AND al.pi = p.pred_idx)""")
def alignment_rows(spark, sf_dir):
    return scoring.alignment_rows(_scored(spark, sf_dir))


@query(f"WITH RECURSIVE {_SCORES} SELECT message_id, gi, field, category, gold_null FROM fs_pred")
def field_scores(spark, sf_dir):
    return scoring.field_scores(_scored(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SCORES} SELECT message_id, kind, gi AS gold_event, field, category AS field_category,
coalesce(CASE field WHEN 'description' THEN CASE WHEN gold_null THEN NULL ELSE 'є деталі' END ELSE gold_value END, '') AS gold_value, coalesce(said, '') AS predicted_value FROM fs_pred JOIN scored USING (message_id)
UNION ALL SELECT message_id, kind, gold_idx, f, 'missed', '', '' FROM gold g JOIN scored USING (message_id), (VALUES {", ".join(f"('{f}')" for f in FIELDS)}) v(f)
WHERE NOT EXISTS (SELECT 1 FROM al_pred al WHERE al.message_id = g.message_id AND al.gi = g.gold_idx)""")
def field_rows(spark, sf_dir):
    return scoring.field_rows(_scored(spark, sf_dir))


@query(f"WITH RECURSIVE {_COUNT} SELECT * FROM ct_pred")
def message_counters(spark, sf_dir):
    return _counters(spark, sf_dir)


_RATES = """sum(correct + invented_ok) / nullif(sum(gold_fields_total), 0)::DOUBLE AS field_accuracy_all, sum(correct + invented_ok) / nullif(sum(paired_fields), 0)::DOUBLE AS field_accuracy_paired,
sum(fabricated) / nullif(sum(paired_gold_null), 0)::DOUBLE AS fabrication_rate, sum(wrong) / nullif(sum(paired_gold_nonnull), 0)::DOUBLE AS wrong_rate, sum(missed) / nullif(sum(paired_gold_nonnull), 0)::DOUBLE AS omission_rate,
sum(wrong + fabricated)::BIGINT AS invented_bad, sum(announcements_detected) / nullif(sum(announcements), 0)::DOUBLE AS detection_rate, sum(traps_clean) / nullif(sum(traps), 0)::DOUBLE AS correct_reject_rate"""


@query(f"WITH RECURSIVE {_COUNT} SELECT {_RATES} FROM ct_pred")
def metrics(spark, sf_dir):
    return scoring.metrics(scoring.summed(_counters(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_COUNT} SELECT 'without_ambiguous' AS slice, {_RATES} FROM ct_pred JOIN scored USING (message_id) WHERE NOT ambiguous
UNION ALL SELECT 'without_boundary', {_RATES} FROM ct_pred JOIN scored USING (message_id) WHERE NOT boundary""")
def slices(spark, sf_dir):
    counters = scoring.message_counters(_scored(spark, sf_dir), ["tags"])
    rates = scoring.metrics(scoring.sliced(counters, {"without_ambiguous": scoring.unambiguous(), "without_boundary": scoring.inside_boundary()}), ["slice"])
    return rates.select(*(c for c in rates.columns if c != "slice"), "slice")


@query(f"""WITH RECURSIVE {_SCORES}, e AS (SELECT field, category, gold_null FROM fs_pred JOIN scored USING (message_id) WHERE kind = 'announcement' UNION ALL
SELECT f, 'missed', false FROM gold g JOIN scored USING (message_id), (VALUES {", ".join(f"('{f}')" for f in FIELDS)}) v(f)
WHERE kind = 'announcement' AND NOT EXISTS (SELECT 1 FROM al_pred al WHERE al.message_id = g.message_id AND al.gi = g.gold_idx))
SELECT field, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in scoring.CATEGORIES)}, count(*) FILTER (category = 'correct' AND gold_null) AS correct_null, count(*) AS total FROM e GROUP BY field""")
def per_field(spark, sf_dir):
    return scoring.per_field_errors(_scored(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COUNT} SELECT subtype, count(*) AS traps, sum(traps_clean)::BIGINT AS clean, sum(trap_false_events)::BIGINT AS false_events, count(*) FILTER (boundary) AS boundary
FROM ct_pred JOIN scored USING (message_id) WHERE ct_pred.kind = 'trap' GROUP BY 1""")
def trap_breakdown(spark, sf_dir):
    of = fx.scored_messages(spark, sf_dir).select("message_id", "category", "tags")
    counters = _counters(spark, sf_dir).join(of, "message_id")
    return scoring.trap_breakdown(counters, scoring.subtype(F.col("category")), F.array_contains("tags", scoring.BOUNDARY_TAG))


def _draws_sql(pred: str, ids: str, columns: list[str], resamples: int) -> str:
    """dr_<pred>: sums of each draw, by the draws that both engines make; sz_<pred>: blocks of messages and their sizes."""
    wide = 1 << 32
    step = lambda x: f"(xor({x}, {x} >> 16) * 73244475) % {wide}"

    def hashed(name: str, start: str, of: str, keep: str) -> str:
        return f"""{name}1 AS (SELECT {keep}, ({start}) % {wide} AS x FROM {of}), {name}2 AS (SELECT {keep}, {step("x")} AS x FROM {name}1), {name}3 AS (SELECT {keep}, {step("x")} AS x FROM {name}2),
{name} AS (SELECT {keep}, xor(x, x >> 16) AS h FROM {name}3)"""

    seed = scoring.RESAMPLING_SEED
    return f"""id_{pred} AS MATERIALIZED (SELECT message_id, {", ".join(columns)} FROM {ids}), nn_{pred} AS (SELECT count(*) AS n, greatest(1, (count(*) + {scoring.DRAWN_BLOCK - 1}) // {scoring.DRAWN_BLOCK}) AS blocks FROM id_{pred}),
{hashed(f"hb_{pred}", f"(message_id % 1000000007) * 2654435761 + {seed}", f"id_{pred}", ", ".join(["message_id", *columns]))},
pl_{pred} AS MATERIALIZED (SELECT {", ".join(columns)}, h % blocks AS k, row_number() OVER (PARTITION BY h % blocks ORDER BY message_id) - 1 AS pos FROM hb_{pred}, nn_{pred}),
sz_{pred} AS MATERIALIZED (SELECT k, s, sum(s) OVER (ORDER BY k) - s AS low FROM (SELECT k, count(*) AS s FROM pl_{pred} GROUP BY k)),
{hashed(f"ha_{pred}", f"draw * 2654435761 + turn * 40503 + {seed}", f"(SELECT draw, unnest(range(n)) AS turn FROM nn_{pred}, range({resamples}) t(draw))", "draw")},
mt_{pred} AS MATERIALIZED (SELECT draw, k, s, count(*) AS times FROM (SELECT draw, h % n AS place FROM ha_{pred}, nn_{pred}) JOIN sz_{pred} ON place >= low AND place < low + s GROUP BY ALL),
{hashed(f"hp_{pred}", f"draw * 2654435761 + turn * 40503 + k * 3266489917 + {seed + 1}", f"(SELECT draw, k, s, unnest(range(times)) AS turn FROM mt_{pred})", "draw, k, s")},
tm_{pred} AS MATERIALIZED (SELECT draw, k, h % s AS pos, count(*) AS times FROM hp_{pred} GROUP BY ALL),
dr_{pred} AS (SELECT draw, sum(times) AS drawn, {", ".join(f"sum({c} * times) AS {c}" for c in columns)} FROM tm_{pred}
  JOIN (SELECT k, pos, {", ".join(f"any_value({c}) AS {c}" for c in columns)} FROM pl_{pred} GROUP BY k, pos) USING (k, pos) GROUP BY draw)"""


@query(f"""WITH RECURSIVE {_COUNT}, {_draws_sql("pred", "ct_pred", ["correct", "invented_ok", "gold_fields_total", "fabricated", "paired_gold_null", "traps", "traps_clean"], scoring.RESAMPLES)}, v AS (
SELECT 'field_accuracy_all' AS metric, (correct + invented_ok) / nullif(gold_fields_total, 0)::DOUBLE AS x FROM dr_pred UNION ALL
SELECT 'fabrication_rate', fabricated / nullif(paired_gold_null, 0)::DOUBLE FROM dr_pred UNION ALL SELECT 'correct_reject_rate', traps_clean / nullif(traps, 0)::DOUBLE FROM dr_pred)
SELECT metric, quantile_cont(x::DOUBLE, 0.025) AS low, quantile_cont(x::DOUBLE, 0.975) AS high FROM v WHERE x IS NOT NULL GROUP BY metric""")
def bootstrap_ci(spark, sf_dir):
    return scoring.bootstrap_intervals(_counters(spark, sf_dir))


@query(f"""WITH RECURSIVE {fx.GOLD}, {fx.SCORED}, {", ".join(f"{fx.predicted_sql(p, n)}, {_aligned_sql(p)}, {_cells_sql(p)}, {_counted_sql(p)}" for p, n in (("p7", 7), ("p3", 3)))},
ct AS (SELECT a.message_id, a.correct + a.invented_ok AS ga, a.gold_fields_total AS ta, b.correct + b.invented_ok AS gb, b.gold_fields_total AS tb FROM ct_p7 a JOIN ct_p3 b USING (message_id)),
{_draws_sql("both", "ct", ["ga", "ta", "gb", "tb"], scoring.RESAMPLES)},
d AS (SELECT ga / nullif(ta, 0)::DOUBLE - gb / nullif(tb, 0)::DOUBLE AS d FROM dr_both)
SELECT (SELECT sum(ga) / nullif(sum(ta), 0)::DOUBLE - sum(gb) / nullif(sum(tb), 0)::DOUBLE FROM ct) AS observed, quantile_cont(d::DOUBLE, 0.025) AS low, quantile_cont(d::DOUBLE, 0.975) AS high FROM d WHERE d IS NOT NULL""")
def paired_bootstrap(spark, sf_dir):
    return scoring.paired_difference(_counters(spark, sf_dir), _counters(spark, sf_dir, 3))


@query(f"""WITH scored AS (SELECT o_orderkey AS message_id, 1 AS messages, CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END AS traps FROM orders), {_draws_sql("o", "scored", ["messages", "traps"], scoring.RESAMPLES)}
SELECT draw, drawn::BIGINT AS messages, traps::BIGINT AS traps FROM dr_o""")
def resample_sizes(spark, sf_dir):
    """Each resample draws as many messages as there are; how many of them are traps."""
    messages = fx.scored_messages(spark, sf_dir)
    return scoring.resampled(messages.select("message_id", F.lit(1).cast("long").alias("messages"), (F.col("kind") == "trap").cast("long").alias("traps")))


@query(f"""WITH RECURSIVE {_COUNT}, h AS (SELECT message_id <= 3100 AS half, sum(correct + invented_ok) / nullif(sum(gold_fields_total), 0)::DOUBLE AS r FROM ct_pred GROUP BY 1)
SELECT max(r) - min(r) AS gap, max(r) - min(r) > 0.05 AS unstable FROM h""")
def halves_gap(spark, sf_dir):
    return scoring.halves_gap(_counters(spark, sf_dir), F.col("message_id") <= 3100)


# Grounding


def _grounded(spark, sf_dir):
    """Each document as a value, held against itself or the text of another; without another, against an empty text."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = d.agg((F.max("doc_id") + 1).alias("n"))
    other = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise((F.col("doc_id") * 7 + 3) % F.col("n"))
    # One row.
    own = d.crossJoin(F.broadcast(n)).select("doc_id", F.col("text").alias("value"), other.alias("other"))
    return own.join(d.select(F.col("doc_id").alias("other"), F.col("text").alias("source")), "other", "left").withColumn("source", F.coalesce("source", F.lit("")))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(grounding.STOP_WORDS)))
_STEM = "CASE WHEN length({0}) >= 4 THEN left({0}, length({0}) - 1) ELSE {0} END"
_GROUND = r"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT max(doc_id) + 1 AS n FROM d),
o AS (SELECT doc_id, text AS value, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE (doc_id * 7 + 3) % n END AS other FROM d, n),
g AS (SELECT o.doc_id, o.value, coalesce(d.text, '') AS source FROM o LEFT JOIN d ON d.doc_id = o.other)"""


@query(rf"""WITH {_GROUND}, v AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(value), '[\p{{L}}\p{{N}}]+')) AS t FROM g) WHERE length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}) GROUP BY 1, 2),
s AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}]+')) AS t FROM g)),
vs AS (SELECT doc_id, c, {_STEM.format("t")} AS x FROM v), ss AS (SELECT DISTINCT doc_id, {_STEM.format("t")} AS y FROM s),
k AS (SELECT DISTINCT doc_id, left(y, 3) AS p3, left(y, 4) AS p4, length(y) >= 4 AS long FROM ss WHERE length(y) >= 3),
h AS (SELECT vs.doc_id, vs.c, CASE WHEN length(x) >= 4 THEN EXISTS (SELECT 1 FROM k WHERE k.doc_id = vs.doc_id AND k.long AND k.p4 = left(x, 4)) OR EXISTS (SELECT 1 FROM k WHERE k.doc_id = vs.doc_id AND NOT k.long AND k.p3 = left(x, 3))
  ELSE length(x) >= 3 AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = vs.doc_id AND k.p3 = x) END AS hit FROM vs)
SELECT g.doc_id, c.coverage FROM g LEFT JOIN (SELECT doc_id, sum(c) FILTER (hit) / sum(c)::DOUBLE AS coverage FROM h GROUP BY 1) c USING (doc_id)""".replace("sum(c) FILTER (hit) /", "coalesce(sum(c) FILTER (hit), 0) /"))
def token_grounding(spark, sf_dir):
    return grounding.coverages(_grounded(spark, sf_dir), "value", "source").select("doc_id", "coverage")


_DIGITS = r"""x AS (SELECT doc_id, doc_id % 40 AS a, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS groups FROM documents)"""


@query(f"WITH {_DIGITS} SELECT doc_id, CASE WHEN list_contains(groups, a::VARCHAR) THEN 'ok' ELSE 'invented' END AS status FROM x")
def digits_grounding(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", grounding.text_status((F.col("doc_id") % 40).cast("string"), F.coalesce("text", F.lit(""))).alias("status"))


@query(f"WITH {_DIGITS} SELECT doc_id, CASE WHEN list_contains(groups, a::VARCHAR) OR contains(array_to_string(groups, ''), a::VARCHAR) THEN 'ok' ELSE 'invented' END AS status FROM x")
def code_grounding(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", grounding.code_status(F.concat(F.lit("ID "), (F.col("doc_id") % 40).cast("string")), F.coalesce("text", F.lit(""))).alias("status"))


_STATUS = "['invented', 'invalid', 'missed', 'suspect', 'ok', 'info', 'empty']"


def _checks(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, grounding.STATUS_ORDER)), (6 - F.least(F.col("event_id") % 7, F.col("user_id") % 7) + 1).cast("int"))
    return e.select("user_id", status.alias("status"))


_CHECKS = f"chk AS (SELECT user_id, {_STATUS}[(6 - least(event_id % 7, user_id % 7) + 1)::INT] AS status FROM events)"


@query(f"WITH {_CHECKS} SELECT user_id, {_STATUS}[min(list_position({_STATUS}, status))] AS worst FROM chk GROUP BY 1")
def worst_status(spark, sf_dir):
    return _checks(spark, sf_dir).groupBy("user_id").agg(grounding.worst_of(grounding.status_rank(F.col("status"))).alias("worst"))


@query(f"WITH {_CHECKS} SELECT status, count(*) AS n FROM chk GROUP BY 1")
def status_histogram(spark, sf_dir):
    return _checks(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Reports


@query(f"WITH {fx.RUNS} SELECT count(*) AS n, coalesce(median(seconds) FILTER (seconds > 0), 0)::DOUBLE AS median, coalesce(max(seconds), 0)::DOUBLE AS most, count(*) FILTER (turn = 0) AS first_turns FROM runs")
def run_stats(spark, sf_dir):
    return reports.run_stats(fx.runs(spark, sf_dir))


@query(f"""WITH {fx.RUNS}, x AS (SELECT CASE WHEN message_id % 7 = 0 THEN 'trap' WHEN message_id % 11 = 0 THEN 'individual' ELSE 'announcement' END AS kind, message_id % 3 AS found, CASE WHEN turn % 9 = 4 THEN 'timeout' END AS error, seconds FROM runs)
SELECT kind, count(*) AS n, count(*) FILTER (error IS NULL AND CASE WHEN kind = 'trap' THEN found = 0 ELSE found > 0 END) AS ok, (median(seconds) FILTER (error IS NULL))::DOUBLE AS median, (max(seconds) FILTER (error IS NULL))::DOUBLE AS most,
round((sum(seconds) FILTER (error IS NULL))::DOUBLE, 2) AS total FROM x GROUP BY 1""")
def bench_summary(spark, sf_dir):
    m = F.col("message_id")
    kind = F.when(m % 7 == 0, "trap").when(m % 11 == 0, "individual").otherwise("announcement")
    out = reports.bench_summary(fx.runs(spark, sf_dir).select(kind.alias("kind"), (m % 3).alias("found"), F.when(F.col("turn") % 9 == 4, "timeout").alias("error"), "seconds"))
    return out.withColumn("total", F.round("total", 2))


@query(f"""WITH {fx.RUNS}, l AS (SELECT model, list_sort(list(seconds)) AS s, round(avg(seconds), 6) AS mean FROM runs WHERE seconds > 0 GROUP BY 1)
SELECT model, s[len(s) // 2 + 1]::DOUBLE AS median, s[least(len(s) - 1, floor(len(s) * 0.95)::BIGINT) + 1]::DOUBLE AS p95, s[1]::DOUBLE AS least, s[-1]::DOUBLE AS most, mean::DOUBLE AS mean FROM l""")
def model_compare(spark, sf_dir):
    return reports.latency_table(fx.runs(spark, sf_dir), "model", "seconds").drop("minutes").withColumn("mean", F.round("mean", 6))


@query(f"WITH {fx.RUNS}, l AS (SELECT model, list_sort(list(seconds)) AS s FROM runs GROUP BY 1) SELECT model, s[least(len(s) - 1, floor(len(s) * 0.95)::BIGINT) + 1]::DOUBLE AS p95 FROM l")
def p95_latency(spark, sf_dir):
    return reports.placed_values(fx.runs(spark, sf_dir), "model", "seconds", {"p95": reports.p95})


@query(f"WITH {fx.RUNS}, l AS (SELECT model, list_sort(list(seconds)) AS s FROM runs GROUP BY 1) SELECT model, s[len(s) // 2 + 1]::DOUBLE AS median FROM l")
def upper_median(spark, sf_dir):
    return reports.placed_values(fx.runs(spark, sf_dir), "model", "seconds", {"median": reports.upper_median})


@query(f"""WITH {fx.RUNS}, x AS (SELECT message_id, model, (max(seconds * 100))::BIGINT::VARCHAR AS answer FROM runs GROUP BY 1, 2)
SELECT message_id, coalesce(max(answer) FILTER (model = 'user'), '—') AS "user", coalesce(max(answer) FILTER (model = 'assistant'), '—') AS assistant, coalesce(max(answer) FILTER (model = 'system'), '—') AS system FROM x GROUP BY 1""")
def pivot_messages(spark, sf_dir):
    answers = fx.runs(spark, sf_dir).groupBy("message_id", "model").agg(F.round(F.max("seconds") * 100).cast("long").cast("string").alias("answer"))
    return reports.pivot_answers(answers, ["user", "assistant", "system"])


@query("SELECT count(*) AS graded, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0 OR doc_id % 5 = 0) AS no, count(*) FILTER (toxic = 1) AS flagged FROM labels")
def verdict_stats(spark, sf_dir):
    send = F.when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), "both").when(F.col("quality") == 1, "yes").otherwise("no")
    return reports.verdict_stats(fx.table(spark, sf_dir, "labels").select(send.alias("send"), (F.col("toxic") == 1).alias("flagged")))


@query("SELECT count(*) FILTER (toxic = 1) AS auto, count(*) FILTER (toxic = 1 AND quality = 0) AS both, count(*) FILTER (toxic = 0 AND quality = 0) AS only_human, count(*) FILTER (toxic = 1 AND quality = 1) AS only_auto FROM labels")
def flag_precision(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    return reports.flag_precision(labels.where("toxic = 1"), labels.where("quality = 0"), "doc_id")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def language_histogram(spark, sf_dir):
    return reports.language_histogram(fx.table(spark, sf_dir, "documents"))


@query(f"""WITH {fx.GOLD}, {fx.predicted_sql("p7", 7)}, {fx.predicted_sql("p3", 3)}, a AS (
  SELECT g.message_id, g.gold_idx AS gi, p.date AS answer FROM gold g JOIN p7 p ON p.message_id = g.message_id AND p.pred_idx = g.gold_idx WHERE p.date <> g.date UNION ALL
  SELECT g.message_id, g.gold_idx, p.date FROM gold g JOIN p3 p ON p.message_id = g.message_id AND p.pred_idx = g.gold_idx WHERE p.date <> g.date)
SELECT message_id, gi, 'date' AS field, answer, count(*) AS models FROM a GROUP BY ALL HAVING count(*) >= 2""")
def consensus_cells(spark, sf_dir):
    gold = fx.gold(spark, sf_dir).select("message_id", F.col("gold_idx").alias("gi"), F.col("date").alias("g_date"))
    parts = []
    for model, shift in (("a", 7), ("b", 3)):
        said = fx.predicted(spark, sf_dir, shift).select("message_id", F.col("pred_idx").alias("gi"), "date")
        wrong = scoring.field_category(F.col("g_date"), F.col("date").isNotNull(), F.col("date") == F.col("g_date"))
        parts.append(gold.join(said, ["message_id", "gi"]).select(F.lit(model).alias("model"), "message_id", "gi", F.lit("date").alias("field"), wrong.alias("category"), F.col("date").alias("answer")))
    return reports.consensus_cells(parts[0].unionByName(parts[1]))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts FROM documents")
def dataset_checks(spark, sf_dir):
    return dataset.table_checks(fx.table(spark, sf_dir, "documents"), "doc_id", "text")


# Sources and streams, on small files written for the purpose


#: Documents as objects of a file: whole, with other names and a bad date, without a text, with a blank one.
_OBJECT_SQL = f"""o AS (SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 3 THEN '  ' WHEN 2 THEN NULL ELSE md5(text) END AS text, source FROM documents),
loaded AS (SELECT doc_id AS message_id, CASE k WHEN 0 THEN strftime(DATE '2024-01-01' + (doc_id % 20)::INT, '%Y-%m-%d') ELSE '{fx.TODAY}' END AS date, text, '@' || source AS channel, CASE k WHEN 0 THEN 'note ' || doc_id::VARCHAR ELSE '' END AS note
  FROM o WHERE k < 2)"""


def _objects(spark, sf_dir):
    n = F.col("doc_id")
    text, day = F.md5(F.encode("text", "utf-8")), F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int")).cast("string")
    whole = F.to_json(F.struct(text.alias("text"), F.concat(day, F.lit("T10:00:00")).alias("date"), F.concat(F.lit("@"), "source").alias("source_channel"), n.alias("source_message_id"), F.concat(F.lit("note "), n.cast("string")).alias("_expect")))
    other = F.to_json(F.struct(text.alias("text"), F.lit("2024-13-40").alias("date"), F.concat(F.lit("@"), "source").alias("channel"), n.alias("id")))
    said = F.when(n % 4 == 0, whole).when(n % 4 == 1, other).when(n % 4 == 2, F.to_json(F.struct(day.alias("date"), n.alias("id")))).otherwise(F.to_json(F.struct(F.lit("  ").alias("text"), n.alias("id"))))
    return fx.table(spark, sf_dir, "documents").select("doc_id", "source", said.alias("value"))


@query(f"WITH {_OBJECT_SQL} SELECT * FROM loaded")
def load_jsonl(spark, sf_dir):
    """Lines of JSON, comments and blank lines between them."""
    from eventloom.sources.messages import load_messages

    path = shared_path(spark)
    lines = _objects(spark, sf_dir).select(F.explode(F.array(F.lit("# comment"), "value", F.lit(""))).alias("value"))
    lines.write.text(path)
    return _as_text(load_messages(spark, path, fx.TODAY)[0])


def _files_of_a_hundred(rows, columns):
    """(part, whole): a text a hundred documents, at most that many."""
    return rows.groupBy(F.floor(F.col("doc_id") / 100).alias("part"), "name").agg(F.sort_array(F.collect_list(F.struct("doc_id", *columns))).alias("rows"))


@query(f"WITH {_OBJECT_SQL} SELECT * FROM loaded")
def load_array(spark, sf_dir):
    """Arrays of JSON, a file for each hundred documents."""
    from eventloom.sources.messages import load_messages

    path = shared_path(spark)
    whole = _files_of_a_hundred(_objects(spark, sf_dir).withColumn("name", F.lit("all")), ["value"])
    whole = whole.select("part", F.concat(F.lit("[\n"), F.array_join(F.transform("rows", lambda r: r["value"]), ",\n"), F.lit("]")).alias("value"))
    whole.repartition("part").write.partitionBy("part").text(path)
    return _as_text(load_messages(spark, f"{path}/part=*", fx.TODAY)[0])


@query("""WITH x AS (SELECT doc_id, doc_id % 5 AS k, md5(text) AS t, source, strftime(DATE '2024-01-01' + (doc_id % 20)::INT, '%Y-%m-%d') AS day FROM documents)
SELECT doc_id AS message_id, day AS date, CASE k WHEN 0 THEN 'part ' || t ELSE t END AS text, source AS channel, '' AS note FROM x WHERE k IN (0, 2)""")
def load_export(spark, sf_dir):
    """Chat exports, a file for each hundred documents and source; service messages, bad dates and empty texts are left out."""
    from eventloom.sources.messages import load_messages

    n, text = F.col("doc_id"), F.md5(F.encode("text", "utf-8"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 20).cast("int")).cast("string")
    parts = F.concat(F.lit('["part ", {"type": "bold", "text": "'), text, F.lit('"}]'))
    said = F.when(n % 5 == 0, parts).when(n % 5 == 3, '""').otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    kind, date = F.when(n % 5 == 1, "service").otherwise("message"), F.when(n % 5 == 4, "bad").otherwise(F.concat(day, F.lit("T00:00:00")))
    message = F.concat(F.lit('{"id": '), n.cast("string"), F.lit(', "type": "'), kind, F.lit('", "date": "'), date, F.lit('", "text": '), said, F.lit("}"))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), message.alias("value"))
    whole = _files_of_a_hundred(rows, ["value"])
    body = F.concat(F.lit('{"name": "'), "name", F.lit('", "messages": ['), F.array_join(F.transform("rows", lambda r: r["value"]), ","), F.lit("]}"))
    path = shared_path(spark)
    whole.select(F.concat_ws("-", "part", "name").alias("file"), body.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return _as_text(load_messages(spark, f"{path}/file=*", fx.TODAY)[0])


def _chat(messages: list[dict], schema: str) -> str:
    """A stand-in for a model: one event, its title the text's first words."""
    text = messages[-1]["content"].split('Message: "', 1)[1][:-1]
    return json.dumps({"events": [{"event_title": " ".join(text.split()[:4]), "time": "25:00", "event_type": "other"}]})


_POST_TEXTS = ["Запрошуємо на лекцію завтра о 14:30", "Гарних вихідних!", "Семінар скасовано.", "Приглашаем на встречу, мы ждём"]


def _posts_of(spark, sf_dir, texts_, start="2024-01-03"):
    """Documents as posts of one channel that take the texts in turn, each on its day."""
    day = F.date_add(F.lit(start).cast("date"), (F.col("doc_id") % 30).cast("int"))
    return _cases(spark, sf_dir, [(t,) for t in texts_], "text string").select(F.col("doc_id").alias("message_id"), F.lit("@a").alias("channel"), "text", day.alias("ref_date"))


@query("""SELECT doc_id AS message_id, 'Запрошуємо на лекцію завтра' AS event_title, strftime(DATE '2024-01-04' + (doc_id % 30)::INT, '%Y-%m-%d') AS date, NULL AS reason FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'Семінар скасовано.', NULL, 'подію скасовано, нової дати немає: «скасовано»' FROM documents WHERE doc_id % 4 = 2""")
def process_messages(spark, sf_dir):
    from eventloom.plans.extract import process

    return _as_text(process(_posts_of(spark, sf_dir, _POST_TEXTS), _chat).select("message_id", "event_title", "date", "reason"))


def _failing(talk: list[dict], schema: str) -> str:
    """A stand-in that fails in the ways a model can."""
    text, turn = talk[0]["content"], (len(talk) + 1) // 2
    if "down" in text:
        raise TimeoutError("too slow")
    if "refused" in text:
        raise ConnectionRefusedError("no server")
    return json.dumps({"events": []}) if "good" in text or ("late" in text and turn > 1) else "{}"


_FAILING = ["good", "down", "refused", "late", "bad"]


@query(_golden("attempts, error, again", [(1, None, None), (3, "unavailable", True), (1, "unavailable", True), (2, None, None), (3, "invalid", False)]).replace("SELECT doc_id,", "SELECT doc_id AS message_id,"))
def extractor_failures(spark, sf_dir):
    from eventloom.plans.extract import ask, failures

    answers = ask(_posts_of(spark, sf_dir, _FAILING), _failing)
    again = failures(answers).select("message_id", "again")
    return answers.select("message_id", "attempts", "error").join(again, "message_id", "left")


@query("""SELECT count(*) AS messages, count(*) FILTER (k = 0) AS first_try, count(*) FILTER (k IN (0, 3)) AS valid, count(*) FILTER (k = 4) AS invalid, count(*) FILTER (k IN (1, 2)) AS unavailable, sum([1, 3, 1, 2, 3][k + 1])::BIGINT AS attempts
FROM (SELECT doc_id % 5 AS k FROM documents)""")
def attempt_stats(spark, sf_dir):
    from eventloom.plans.extract import ask, attempt_stats

    return attempt_stats(ask(_posts_of(spark, sf_dir, _FAILING), _failing))


_REPLAYED = [
    (1, 0, "Лекція з ML", "2024-01-05", "uk", None), (1, 1, " лекція З ml ", "2024-01-05", "uk", "дубль у межах повідомлення"), (1, 2, " ", None, "uk", "не валідується"),
    (2, 0, "Х", None, None, "пре-фільтр не пропустив (score=0.0)"), (3, 0, "Семінар", None, "uk", "подію скасовано, нової дати немає: «скасовано»"),
    (4, 0, "Консультація", "2024-01-09", "uk", "індивідуальний формат: персональний формат: за попереднім записом"), (5, 0, "Встреча", None, "ru", "повідомлення російською — факультет веде канал українською"),
]
_REPLAY_TEXTS = {
    1: "Запрошуємо на лекцію 5 січня о 14:30", 2: "Гарних вихідних усім!", 3: "Семінар скасовано.", 4: "Консультація 9 січня за попереднім записом, реєстрація о 10:00", 5: "Приглашаем на встречу, мы ждём",
}


@query(_golden("ordinal, dropped", [(m - 1, o, d) for m, o, _, _, _, d in _REPLAYED], len(_REPLAY_TEXTS)).replace("SELECT doc_id,", "SELECT doc_id AS message_id,"))
def replayed_events(spark, sf_dir):
    """Saved answers through the write path's filters, with what each would be dropped for."""
    from eventloom.plans.extract import FIELDS as WRITTEN
    from eventloom.plans.extract import replayed

    said = [([(o, t, d, g) for m, o, t, d, g, _ in _REPLAYED if m == n], text) for n, text in sorted(_REPLAY_TEXTS.items())]
    rows = _cases(spark, sf_dir, said, "events array<struct<ordinal:int,event_title:string,date:string,language:string>>, text string")
    events = rows.select(F.col("doc_id").alias("message_id"), F.lit("@a").alias("channel"), "text", F.lit("2024-01-03").cast("date").alias("ref_date"), F.explode("events").alias("e")).select("message_id", "channel", "text", "ref_date", "e.*")
    events = events.withColumns({f: F.lit(None).cast("string") for f in WRITTEN if f not in ("event_title", "date", "language")})
    return replayed(events).select("message_id", "ordinal", "dropped")


_CHECKED = lambda field, status: {"field": field, "status": status}
_REPORTS = [{"meta": {"model": m, "use_schema": True}, "records": [
    {"index": 0, "message_id": 1, "expect": "подія", "attempts": 1, "valid_json": True, "latency_s": 2.0 + k, "events": [{"event_title": "x"}], "events_destiny": [{"db": "saved"}],
     "event_checks": [[_CHECKED("date", "invented"), _CHECKED("time", "missed")]], "message_checks": [_CHECKED("link", "missed"), _CHECKED("events", "missed")]},
    {"index": 1, "message_id": 2, "expect": "ПАСТКА: реклама", "attempts": 2, "valid_json": True, "latency_s": 4.0, "events": [{"event_title": "y"}] * k, "events_destiny": [{"db": "filtered"}] * k,
     "event_checks": [[_CHECKED("date", "suspect")]] * k, "message_checks": [_CHECKED("events", "missed")]},
    {"index": 2, "message_id": 3, "expect": "ІНДИВІДУАЛЬНА консультація", "attempts": 3, "valid_json": False, "error": "збій", "latency_s": 0.0, "events": [], "events_destiny": [], "event_checks": [], "message_checks": []},
]} for k, m in enumerate(["a", "b"])]


def _reports(spark, sf_dir):
    """Reports of two models, a line for each hundred documents: a record a document, of the three kinds in turn."""
    from eventloom.sources.gold import load_reports

    lines = [tuple(json.dumps(r["records"][k] | {"index": 987654321, "message_id": 987654321}, ensure_ascii=False) for r in _REPORTS) for k in range(3)]
    rows = _cases(spark, sf_dir, lines, "a string, b string")
    numbered = [F.replace(m, F.lit("987654321"), F.col("doc_id").cast("string")).alias(m) for m in ("a", "b")]
    parts = rows.select("doc_id", *numbered).groupBy(F.floor(F.col("doc_id") / 100)).agg(*(F.array_join(F.collect_list(m), ",").alias(m) for m in ("a", "b")))
    report = lambda m: F.concat(F.lit(f'{{"meta": {{"model": "{m}", "use_schema": true}}, "records": ['), F.col(m), F.lit("]}"))
    path = shared_path(spark)
    parts.select(F.explode(F.array(report("a"), report("b"))).alias("value")).write.text(path)
    return load_reports(spark, path)


_THIRDS = "n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n0, count(*) FILTER (doc_id % 3 = 1) AS n1, count(*) FILTER (doc_id % 3 = 2) AS n2 FROM documents)"


@query(f"""WITH {_THIRDS}, m(model, k) AS (VALUES ('a', 0::BIGINT), ('b', 1::BIGINT))
SELECT model, n AS messages, n0 AS first_try, n2 AS errors, n0 + k * n1 AS events, n0 AS invented, k * n1 AS suspect, 2 * n0 AS missed_fields, n0 AS ann_found, n0 AS ann_to_db, (1 - k) * n1 AS traps_clean, 0::BIGINT AS trap_to_db, 0::BIGINT AS individual_found,
(SELECT median(CASE doc_id % 3 WHEN 0 THEN 2.0 + k ELSE 4.0 END) FROM documents WHERE doc_id % 3 < 2)::DOUBLE AS median_s, 4.0::DOUBLE AS max_s FROM n, m""")
def model_summary(spark, sf_dir):
    return review.model_summary(_reports(spark, sf_dir)).select(
        "model", "messages", "first_try", "errors", "events", "invented", "suspect", "missed_fields", "ann_found", "ann_to_db", "traps_clean", "trap_to_db", "individual_found", "median_s", "max_s"
    )


@query(_golden("a, b", [("1 → БД", "1 → БД"), ("—", "1 (відс.)"), ("збій", "збій")]).replace("SELECT doc_id,", "SELECT doc_id AS message_id,"))
def model_answers(spark, sf_dir):
    return review.model_answers(_reports(spark, sf_dir), ["a", "b"])


@query(f"WITH {_THIRDS} SELECT 2 * n AS total, 2 * n0 + n1 AS events, 2 * n2 AS errors, 2 * n0 AS first_try, 2 * n0 AS invented, 2 * n0 AS missed, n1 AS suspect FROM n")
def run_totals(spark, sf_dir):
    return review.run_totals(_reports(spark, sf_dir)).select("total", "events", "errors", "first_try", "invented", "missed", "suspect")


_VERDICT = "index int, message_id long, auto_worst string, events array<struct<send:string,in_db:boolean>>, field_counts struct<correct:int,invented_ok:int,invented_bad:int,missed:int>, field_marks map<string,string>, bad_fields array<string>, cleared_flags int, verdict string"
_VERDICTS_SQL = """vd AS (
  SELECT doc_id::INT AS index, doc_id % 50 AS message_id, ['invented', 'suspect', 'ok', 'missed'][(doc_id % 4 + 1)::INT] AS worst, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE ['ok', 'hallucination', 'miss', 'both'][(doc_id % 4 + 1)::INT] END AS verdict,
         quality, toxic, doc_id % 9 = 0 AS silent FROM labels)"""


def _verdicts(spark, sf_dir):
    n = F.col("doc_id")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (n % 4 + 1).cast("int"))
    send = F.when(n % 9 != 0, F.when(F.col("quality") == 1, "yes").otherwise("no"))
    counts = F.struct((n % 4).cast("int").alias("correct"), (n % 3).cast("int").alias("invented_ok"), F.col("toxic").cast("int").alias("invented_bad"), F.lit(1).alias("missed"))
    return fx.table(spark, sf_dir, "labels").select(
        n.cast("int").alias("index"), (n % 50).alias("message_id"), pick(["invented", "suspect", "ok", "missed"]).alias("auto_worst"),
        F.array(F.struct(send.alias("send"), (F.col("toxic") == 1).alias("in_db")), F.struct(send.alias("send"), F.lit(True).alias("in_db"))).alias("events"), counts.alias("field_counts"),
        F.when((F.col("toxic") == 1) & (n % 9 != 0), F.create_map(F.lit("date"), F.lit("invented_bad"))).alias("field_marks"), F.when(n % 2 == 0, F.array(F.lit("date"))).alias("bad_fields"),
        (n % 2).cast("int").alias("cleared_flags"), F.when(n % 9 != 0, pick(["ok", "hallucination", "miss", "both"])).alias("verdict"),
    )


@query(f"""WITH {_VERDICTS_SQL} SELECT count(*) AS graded, count(*) FILTER (verdict = 'ok') AS clean, count(*) FILTER (verdict IN ('hallucination', 'both')) AS hallucinated, count(*) FILTER (verdict IN ('miss', 'both')) AS missing,
sum(index % 4)::BIGINT AS fields_correct, sum(index % 3)::BIGINT AS fields_invented_ok, sum(toxic)::BIGINT AS fields_invented_bad, count(*) AS fields_missed, 2 * count(*) AS events, 2 * count(*) AS rated,
count(*) + sum(toxic)::BIGINT AS to_db, (sum(1 + toxic) FILTER (quality = 1))::BIGINT AS approved, (sum(1 + toxic) FILTER (quality = 0))::BIGINT AS rejected, sum(index % 2)::BIGINT AS cleared, sum(toxic)::BIGINT AS added FROM vd WHERE NOT silent""")
def verdict_summary(spark, sf_dir):
    return review.verdict_summary(_verdicts(spark, sf_dir))


@query(f"""WITH {_VERDICTS_SQL}, x AS (SELECT worst = 'invented' AS hard, worst IN ('invented', 'suspect', 'missed') AS flag, verdict IN ('hallucination', 'both') AS bad FROM vd WHERE NOT silent)
SELECT count(*) FILTER (hard) AS hard, count(*) FILTER (hard AND bad) AS hard_confirmed, count(*) FILTER (flag) AS any_flag, count(*) FILTER (flag AND bad) AS any_confirmed, count(*) FILTER (bad) AS human_bad,
count(*) FILTER (bad AND NOT flag) AS unnoticed, count(*) FILTER (flag AND NOT bad) AS false_alarms FROM x""")
def flag_quality(spark, sf_dir):
    return review.flag_quality(_verdicts(spark, sf_dir))


@query(f"""WITH {_VERDICTS_SQL}, c AS (SELECT doc_id AS card, (doc_id * 3)::INT AS index, doc_id % 60 AS message_id FROM labels), m AS (SELECT message_id, arg_min(verdict, index) AS verdict FROM vd WHERE verdict IS NOT NULL GROUP BY 1)
SELECT card, coalesce(vd.verdict, m.verdict) AS verdict FROM c LEFT JOIN vd ON vd.index = c.index LEFT JOIN m ON m.message_id = c.message_id""")
def cards_with_verdicts(spark, sf_dir):
    n = F.col("doc_id")
    cards = fx.table(spark, sf_dir, "labels").select(n.alias("card"), (n * 3).cast("int").alias("index"), (n % 60).alias("message_id"))
    told = _verdicts(spark, sf_dir)
    return review.cards_with_verdicts(cards, told.where("verdict is not null").select("index", "message_id", "verdict")).select("card", "verdict")


def _two_models(spark, sf_dir):
    shifts = {"_p7": 7, "_p3": 3}
    return scoring.judged(fx.scored_orders(spark, sf_dir, shifts), list(shifts))


_TWO = f"{fx.GOLD}, {fx.SCORED}, " + ", ".join(f"{fx.predicted_sql(p, n)}, {_aligned_sql(p)}, {_cells_sql(p)}" for p, n in (("p7", 7), ("p3", 3)))
_SHOWN = "CASE WHEN category IN ('correct', 'invented_ok') THEN 'ok' ELSE coalesce(said, 'null') || ' (' || category || ')' END"


@query(f"""WITH RECURSIVE {_TWO}, w AS (
SELECT coalesce(a.message_id, b.message_id) AS message_id, coalesce(a.gi, b.gi) AS gi, coalesce(a.field, b.field) AS field, coalesce(a.v, '—') AS p7, coalesce(b.v, '—') AS p3
FROM (SELECT message_id, gi, field, {_SHOWN} AS v FROM fs_p7) a FULL JOIN (SELECT message_id, gi, field, {_SHOWN} AS v FROM fs_p3) b ON a.message_id = b.message_id AND a.gi = b.gi AND a.field = b.field)
SELECT * FROM w WHERE p7 NOT IN ('ok', '—') OR p3 NOT IN ('ok', '—')""")
def disagreements(spark, sf_dir):
    return review.disagreements(_two_models(spark, sf_dir), ["p7", "p3"])


@query(f"""WITH RECURSIVE {_TWO}, bad AS (SELECT message_id, gi, field, lower(coalesce(said, '')) AS v FROM (SELECT * FROM fs_p7 UNION ALL SELECT * FROM fs_p3) JOIN scored USING (message_id) WHERE kind <> 'trap' AND category NOT IN ('correct', 'invented_ok')),
s AS (SELECT DISTINCT message_id, gi, field FROM (SELECT message_id, gi, field, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS v FROM bad) GROUP BY message_id, gi, field, v HAVING count(*) >= 2),
t AS (SELECT message_id FROM (SELECT DISTINCT message_id, 'a' AS m FROM p7 UNION ALL SELECT DISTINCT message_id, 'b' FROM p3) JOIN scored USING (message_id) WHERE kind = 'trap' GROUP BY 1 HAVING count(*) >= 2)
SELECT message_id, count(*) AS consensus FROM s GROUP BY 1 UNION ALL SELECT message_id, 1 FROM t""")
def review_consensus(spark, sf_dir):
    return review.consensus(_two_models(spark, sf_dir), ["p7", "p3"])


@query(f"""WITH RECURSIVE {_TWO} {" UNION ALL ".join(f"""SELECT '{p}' AS model, g.message_id, 'missed_event' AS status, g.event_title AS title FROM gold g JOIN scored USING (message_id) WHERE NOT EXISTS (SELECT 1 FROM al_{p} al WHERE al.message_id = g.message_id AND al.gi = g.gold_idx)
UNION ALL SELECT '{p}', p.message_id, CASE kind WHEN 'trap' THEN 'false_event' ELSE 'extra_event' END, p.event_title FROM {p} p JOIN scored USING (message_id) WHERE NOT EXISTS (SELECT 1 FROM al_{p} al WHERE al.message_id = p.message_id AND al.pi = p.pred_idx)""" for p in ("p7", "p3"))}""")
def event_notes(spark, sf_dir):
    return review.event_notes(_two_models(spark, sf_dir), ["p7", "p3"])


# Gold sets


_PHRASES = [
    ("завтра", "2026-11-03", True), ("через два тижні", "2026-11-16", True), ("цього четверга", "2026-11-05", True), ("наступної п'ятниці", "2026-11-13", True), ("у найближчу суботу", "2026-11-07", True),
    ("у понеділок", "2026-11-09", True), ("у середу, 4 листопада", "2026-11-04", False), ("у четвер, 4 листопада", None, None), ("15 травня 2027 року", "2027-05-15", False), ("1 листопада", "2027-11-01", False),
    ("05.12", "2026-12-05", False), ("05.12.2025", "2025-12-05", False), ("з 10 по 12 грудня", "2026-12-10", False), ("10–12 грудня", "2026-12-10", False), ("з 30 листопада по 2 грудня", "2026-11-30", False),
    ("31 листопада", None, None), ("колись", None, None),
]


@query(_golden("phrase, date, inferred", _PHRASES))
def phrase_dates(spark, sf_dir):
    rows = _cases(spark, sf_dir, [(p,) for p, *_ in _PHRASES], "phrase string")
    found = dataset.resolve_phrase(F.col("phrase"), F.lit(_MONDAY).cast("date"))
    return rows.select("doc_id", "phrase", found.alias("f")).select("doc_id", "phrase", F.col("f.date").cast("string").alias("date"), "f.inferred")


_EXPLICIT = [("з 10 листопада о 11.00", "10 листопада"), ("об 11.00 і 12.10.2026", "12.10.2026"), ("15-16 грудня, 05.13", "15-16 грудня"), ("до 17.30 завтра", ""), ("оцінка 4.05", "4.05")]


@query(_golden("text, dates", _EXPLICIT))
def explicit_dates(spark, sf_dir):
    return _cases(spark, sf_dir, [(t,) for t, _ in _EXPLICIT], "text string").select("doc_id", "text", F.array_join(dataset.explicit_dates(F.col("text")), "|").alias("dates"))


def _gold_message(n: int, **change) -> dict:
    """A message without errors, but for what is changed."""
    field = lambda value, *keys: {"value": value, "keys": [[k] for k in keys]}
    event = {
        "event_title": field("Лекція з ML", "лекція"), "date": {"value": "2026-11-03", "inferred": True, "phrase": "завтра"}, "time": {"value": "14:30", "phrase": "14:30"}, "location": field("ауд. 305", "305"),
        "organizer": field(None), "target_audience": field(None), "event_type": {"value": "lecture", "accept": []}, "description": {"present": False}, "language": {"value": "uk"},
        "link": {"value": "https://a.ua/x"}, "meeting_code": field("ID 12 34", "1234"),
    }
    for name, parts in change.pop("event", {}).items():
        event[name] = {**event[name], **parts}
    text = "Лекція з ML завтра о 14:30 в ауд. 305, https://a.ua/x, ID 12 34. " + "слово " * 45
    gold = {"kind": "announcement", "category": "single", "tags": [], "reaches_db": True, "events": [event]} | change.pop("gold", {})
    return {"source_message_id": n, "date": _MONDAY, "text": text, "source_channel": "@a", "_expect": "", "gold": gold} | change


_GOLD_SET = [
    _gold_message(1), _gold_message(2, text="Лекція завтра"), _gold_message(3, gold={"kind": "trap"}), _gold_message(4, event={"date": {"value": "2026-11-04"}, "location": {"keys": [["404"]]}, "language": {"value": "en"}}),
    _gold_message(5, event={"event_type": {"value": "party"}, "time": {"value": "15:30"}, "meeting_code": {"keys": [["999"]]}, "link": {"value": None}}), _gold_message(6, gold={"events": [], "reaches_db": False}),
    _gold_message(7, text=_gold_message(7)["text"] + " у четвер 4 листопада"),
]
_GOLD_ERRORS = [
    (2, "short_text", None), (2, "links", None), (2, "time_phrase", 0), (2, "keys_location", 0), (2, "link_in_text", 0), (2, "meeting_code", 0), (3, "note_prefix", None), (3, "trap_with_events", None),
    (4, "date_value", 0), (4, "keys_location", 0), (4, "language", 0), (5, "event_type", 0), (5, "time_value", 0), (5, "meeting_code", 0), (5, "links", None), (6, "no_events", None), (6, "reaches_db", None), (6, "links", None),
    (6, "explicit_date", None), (6, "time_in_text", None), (7, "weekday_of_date", None), (7, "explicit_date", None),
]


def _gold_set(spark, sf_dir):
    """A gold set of as many messages as there are documents, a line each, with the mistakes of the cases in turn."""
    from eventloom.sources.gold import load_gold

    lines = [(json.dumps(m | {"source_message_id": 987654321}, ensure_ascii=False),) for m in _GOLD_SET]
    path = shared_path(spark)
    _cases(spark, sf_dir, lines, "value string").select(F.replace("value", F.lit("987654321"), F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return load_gold(spark, path)


@query(_golden("rule, event", [(n - 1, rule, event) for n, rule, event in _GOLD_ERRORS if (n, rule) != (6, "explicit_date")], len(_GOLD_SET)).replace("SELECT doc_id,", "SELECT doc_id AS message_id,"))
def dataset_errors(spark, sf_dir):
    return dataset.message_errors(_gold_set(spark, sf_dir))


@query("SELECT count(*) AS n, true AS unique_ids, false AS unique_texts, count(*) FILTER (doc_id % 7 <> 2) AS announcement, count(*) FILTER (doc_id % 7 = 2) AS trap, 0::BIGINT AS individual, count(*) FILTER (doc_id % 7 <> 5) AS events FROM documents")
def gold_set_checks(spark, sf_dir):
    return dataset.set_checks(_gold_set(spark, sf_dir))


# Evidence in the text


_EVIDENCE = [
    (1, "Лекція у ауд. 305", "Завтра лекції: ауд. 305, 305 місць", "Завтра <mark>лекції</mark>: <mark>ауд</mark>. <mark>305</mark>, <mark>305</mark> місць"), (2, "конференція", "консультація", "консультація"),
    (3, "Відкриття виставки", "відкриття виставка", "<mark>відкриття</mark> <mark>виставка</mark>"),
]


@query(_golden("marked", [(m,) for _, _, _, m in _EVIDENCE]).replace("SELECT doc_id,", "SELECT doc_id AS message_id,"))
def marked_evidence(spark, sf_dir):
    """Places that support a value, merged and marked."""
    from eventloom.sources.sinks import highlight

    rows = _cases(spark, sf_dir, [r[1:3] for r in _EVIDENCE], "value string, source string").withColumnRenamed("doc_id", "message_id")
    merged = reports.merge_spans(grounding.value_spans(rows, "message_id", "value", "source"), ["message_id"])
    spans = merged.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.join(spans, "message_id", "left").select("message_id", highlight(F.col("source"), F.coalesce("spans", none)).alias("marked"))


@query("""SELECT doc_id AS message_id, 'manual:' || (doc_id % 9)::VARCHAR AS channel, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'caption' END AS text,
strftime(CASE WHEN doc_id % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-01-03' END + (doc_id % 20)::INT, '%Y-%m-%d') AS ref_date FROM documents WHERE doc_id % 3 < 2""")
def manual_posts(spark, sf_dir):
    """Documents as posts by hand: with a text, with a caption alone, with neither; half of them forwarded."""
    from eventloom.sources.messages import manual_posts

    n, at = F.col("doc_id"), lambda day: F.date_format(F.date_add(F.lit(day).cast("date"), (F.col("doc_id") % 20).cast("int")), "yyyy-MM-dd'T'09:00:00")
    posts = fx.table(spark, sf_dir, "documents").select(
        (n % 9).alias("chat_id"), n.alias("message_id"), F.when(n % 3 == 0, F.md5(F.encode("text", "utf-8"))).when(n % 3 == 1, "").alias("text"), F.when(n % 3 == 1, "caption").when(n % 3 == 2, "").alias("caption"),
        F.when(n % 2 == 0, at("2024-01-01")).alias("origin_date"), at("2024-01-03").alias("date"),
    )
    return _as_text(manual_posts(posts))


@query()
def stream_pipeline(spark, sf_dir):
    """The documents as a stream of files, gated and appended batch by batch."""
    from eventloom.streaming.ingest import run_available

    schema = fx.table(spark, sf_dir, "documents").schema
    out, checkpoint = shared_path(spark), shared_path(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")

    def batch(df: DataFrame, n: int) -> None:
        gated = df.where(rules.is_candidate(F.col("text"), 3.0, _WORDS)).select("doc_id", rules.prefilter_score(F.col("text"), _WORDS).alias("score"))
        gated.write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_available(stream, checkpoint, batch)
    return spark.read.schema("doc_id long, score double").parquet(f"{out}/batch=*")


@query()
def stream_dedup(spark, sf_dir):
    """The first document of each title hash, by the stream's state."""
    from eventloom.streaming.ingest import deduplicated, run_available

    schema = fx.table(spark, sf_dir, "documents").schema
    out, checkpoint = shared_path(spark), shared_path(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    titled = stream.select("doc_id", F.coalesce("text", F.lit("")).alias("title"), F.lit(None).cast("date").alias("date"))
    run_available(deduplicated(titled, "title", "date"), checkpoint, lambda df, n: df.select("content_hash").write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema("content_hash string").parquet(f"{out}/batch=*")
