"""The ingest queue as a table: claims, leases, retries and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["queued", "processing", "done", "failed"]
ERROR_CHARS = 4000


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def enqueue(jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages without an active job of the same channel and message_id; a null key never matches."""
    active = jobs.where(F.col("status").isin("queued", "processing")).select("channel", "message_id").distinct()
    return messages.join(active, ["channel", "message_id"], "left_anti")


def latest_active(jobs: DataFrame) -> DataFrame:
    active = jobs.where(F.col("status").isin("queued", "processing"))
    return active.groupBy("channel", "message_id").agg(F.max("id").alias("job_id"))


def claim(jobs: DataFrame, batch: int, now: str) -> DataFrame:
    """The first so many queued jobs that are due, as the worker gets them."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= moment(now))).orderBy("id").limit(batch)
    return ready.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": moment(now)})


#: What is said of jobs whose worker fell silent.
LOST, REQUEUED = "Воркер не завершил задачу за отведённое время", "Задача возвращена в очередь: воркер не отчитался"


def _kept(jobs: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in jobs.columns else F.lit(None).cast(kind)


def _free() -> dict[str, Column]:
    return {"locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string")}


def requeue_stale(jobs: DataFrame, lease_seconds: int, max_attempts: int, now: str) -> DataFrame:
    """Jobs whose lock is older than the lease: free and due again, or failed and finished after too many attempts."""
    limit = moment(now) - F.make_dt_interval(secs=F.lit(lease_seconds))
    stale = jobs.where((F.col("status") == "processing") & (F.col("locked_at") < limit))
    over = F.col("attempts") >= max_attempts
    return stale.withColumns(
        {
            "status": F.when(over, "failed").otherwise("queued"), "available_at": F.when(over, F.col("available_at")).otherwise(moment(now)),
            "finished_at": F.when(over, moment(now)).otherwise(_kept(jobs, "finished_at", "timestamp_ntz")), "last_error": F.when(over, LOST).otherwise(REQUEUED), **_free(),
        }
    )


def mark_done(jobs: DataFrame, which: Column, now: str) -> DataFrame:
    """Finished without error and free; other jobs stay as they are."""
    set_to = {"status": F.lit("done"), "finished_at": moment(now), "last_error": F.lit(None).cast("string"), **_free()}
    kinds = {"status": "string", "finished_at": "timestamp_ntz", "last_error": "string", "locked_at": "timestamp_ntz", "locked_by": "string"}
    return jobs.withColumns({c: F.when(which, v).otherwise(_kept(jobs, c, kinds[c])) for c, v in set_to.items()})


def mark_failed(jobs: DataFrame, error: Column, backoff_seconds: int, max_attempts: int, now: str) -> DataFrame:
    """Failed for good after so many attempts, else queued after a wait that doubles each time; free either way."""
    over = F.col("attempts") >= max_attempts
    wait = F.lit(backoff_seconds) * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0)))
    later = moment(now) + F.make_dt_interval(secs=wait)
    return jobs.withColumns(
        {
            "status": F.when(over, "failed").otherwise("queued"), "available_at": F.when(over, F.col("available_at")).otherwise(later),
            "finished_at": F.when(over, moment(now)).otherwise(_kept(jobs, "finished_at", "timestamp_ntz")), "last_error": F.substring(error, 1, ERROR_CHARS), **_free(),
        }
    )


def release(jobs: DataFrame, now: str, reason: Column | None = None) -> DataFrame:
    """Back to the queue without a penalty, due at once."""
    return jobs.withColumns(
        {"status": F.lit("queued"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), "available_at": moment(now), "last_error": F.lit(None).cast("string") if reason is None else reason, **_free()}
    )


def due_again(jobs: DataFrame, batch_time: str) -> DataFrame:
    """The retry table of a micro-batch: failed before, waited long enough."""
    return jobs.where((F.col("status") == "queued") & (F.col("attempts") > 0) & (F.col("available_at") <= moment(batch_time)))


def recent(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("id")).limit(limit)


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, and durations of those done (mean rounded half to even)."""
    timed = (F.col("status") == "done") & F.col("duration_ms").isNotNull()
    return jobs.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.bround(F.avg(F.when(timed, F.col("duration_ms")))).cast("long").alias("avg_ms"),
        F.max(F.when(timed, F.col("duration_ms"))).cast("long").alias("max_ms"),
        F.count_if(timed).alias("timed"),
    )


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: deduplication by rank."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
