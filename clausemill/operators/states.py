"""State machines over events, as batch plans: limits, quotas, sessions, the job queue, payments, caches.

Order matters inside a user, a job or a day only, so windows are partitioned by these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts in a window of seconds.
ATTEMPTS, SECONDS = 5, 60
GLOBAL_QUOTA, USER_QUOTA = 80, 5
IDLE_MINUTES, MAX_SESSIONS = 30, 5
ORPHAN_MINUTES, STALE_MINUTES = 15, 90


def admit(recorded: list[float], now: float, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> bool:
    """Whether an attempt passes the sliding window; only those that pass are recorded."""
    recorded[:] = [t for t in recorded if now - t < seconds]
    if len(recorded) >= attempts:
        return False
    recorded.append(now)
    return True


def rate_limited(attempts: DataFrame) -> DataFrame:
    """id, allowed for attempts(id, user_id, ts). Refused attempts don't count, so each user's are folded in order; a
    fold holds the last few times of one user, whatever the number of attempts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recorded = object(), []
        for p in parts:
            allowed = []
            for u, t in zip(p["user_id"], p["t"], strict=True):
                if u != user:
                    user, recorded = u, []
                allowed.append(admit(recorded, t))
            yield pd.DataFrame({"id": p["id"], "allowed": allowed})

    t = attempts.select("id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("id", "user_id", (F.col("us") / 1e6).alias("t"))
    return t.repartition("user_id").sortWithinPartitions("user_id", "t", "id").mapInPandas(run, "id long, allowed boolean")


def daily_quota(asks: DataFrame, everyone: int = GLOBAL_QUOTA, each: int = USER_QUOTA) -> DataFrame:
    """id, outcome for asks(id, user_id, ts): 1, or -1 once a day's quota is used, or -2 once the user's is.

    While the day's quota lasts, a user's first asks are the ones that pass; so the quota ends with the `everyone`-th of
    these, and only that many of a day are compared.
    """
    t = asks.withColumn("day", F.to_date("ts"))
    mine = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "id"))
    t = t.withColumn("mine", mine)
    n = F.row_number().over(Window.partitionBy("day").orderBy("ts", "id"))
    first = t.where(F.col("mine") <= each).withColumn("n", n).where(F.col("n") <= everyone)
    end = first.where(F.col("n") == everyone).select("day", F.struct("ts", "id").alias("end"))
    late = F.col("end").isNotNull() & (F.struct("ts", "id") > F.col("end"))
    return t.join(end, "day", "left").select("id", F.when(late, -1).when(F.col("mine") > each, -2).otherwise(1).alias("outcome"))


def in_flight(changes: DataFrame) -> DataFrame:
    """id, held for changes(id, user_id, ts, change): how many a user holds after each; a release of nothing is none."""
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    t = changes.withColumn("sum", F.sum("change").over(w))
    least = F.least(F.lit(0), F.min("sum").over(w))
    return t.select("id", (F.col("sum") - least).alias("held"))


def sessions(seen: DataFrame) -> DataFrame:
    """id, active, allowed for seen(id, user_id, key, ts): sessions of the user that were seen within the idle time."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-IDLE_MINUTES * 60 * 1_000_000, 0)
    t = seen.select("id", F.size(F.collect_set("key").over(w)).cast("long").alias("active"))
    return t.withColumn("allowed", F.col("active") <= MAX_SESSIONS)


def jobs(events: DataFrame) -> DataFrame:
    """job_id, document_id, user_id, status, created_at, started_at, updated_at of events(seq, job_id, ..., ts, event)."""
    status = F.max_by(F.when(F.col("event") != "heartbeat", F.col("event")), F.when(F.col("event") != "heartbeat", F.struct("ts", "seq")))
    return events.groupBy("job_id").agg(
        F.min("document_id").alias("document_id"),
        F.min("user_id").alias("user_id"),
        F.coalesce(status, F.lit("queued")).alias("status"),
        F.min("ts").alias("created_at"),
        F.max(F.when(F.col("event") == "running", F.col("ts"))).alias("started_at"),
        F.max("ts").alias("updated_at"),
    )


def queue_ahead(queued: DataFrame) -> DataFrame:
    """job_id, ahead: queued jobs that were created before. Days are counted, and only a day's jobs are ranked together."""
    t = queued.withColumn("day", F.to_date("created_at"))
    per_day = t.groupBy("day").agg(F.count("*").alias("n"))  # a row for each day
    before = per_day.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.rank().over(Window.partitionBy("day").orderBy("created_at")) - 1
    return t.withColumn("rank", rank).join(before.select("day", "before"), "day").select("job_id", (F.col("before") + F.col("rank")).alias("ahead"))


def claims(jobs: DataFrame, everyone: int, each: int) -> DataFrame:
    """job_id, claimed, queue_ahead, reason of a claim for each job as things stand."""
    running = jobs.where("status = 'running'")
    total = running.agg(F.count("*").alias("total"))  # one row
    mine = running.groupBy("user_id").agg(F.count("*").alias("mine"))
    ahead = queue_ahead(jobs.where("status = 'queued'"))
    t = jobs.join(mine, "user_id", "left").join(ahead, "job_id", "left").crossJoin(F.broadcast(total))
    busy = (F.col("total") >= max(everyone, 1)) | (F.coalesce("mine", F.lit(0)) >= max(each, 1))
    reason = F.when(F.col("status") != "queued", F.col("status")).when(busy, "slots_busy").otherwise("claimed")
    return t.select("job_id", (reason == "claimed").alias("claimed"), F.coalesce("ahead", F.lit(0)).alias("queue_ahead"), reason.alias("reason"))


def lost(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, reason of running jobs without a heartbeat, and of those that take too long."""
    orphan = F.col("updated_at") < now - F.expr(f"INTERVAL {ORPHAN_MINUTES} MINUTES")
    stale = F.col("started_at") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    return jobs.where("status = 'running'").select("job_id", F.when(orphan, "orphan").when(stale, "stale").alias("reason")).where("reason IS NOT NULL")


def failed_documents(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """document_id, job_id: documents still in processing whose latest job failed."""
    open_ = docs.where(F.col("status").isin("pdf_processing", "admin_processing", "pending_admin_review")).select(F.col("id").alias("document_id"))
    latest = jobs.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("j"))
    return open_.join(latest, "document_id").where("j.status = 'failed'").select("document_id", "j.job_id")


def payments(events: DataFrame) -> DataFrame:
    """subscription_id, status, price for events(subscription_id, seq, type, paid, cents): the last event counts; one
    that isn't paid can only cancel."""
    last = events.groupBy("subscription_id").agg(F.max_by(F.struct("type", "paid", "cents"), "seq").alias("e"))
    status = F.when((F.col("e.type") == "deleted") | ~F.col("e.paid"), "cancelled").otherwise("active")
    return last.select("subscription_id", status.alias("status"), (F.col("e.cents") / 100).alias("price"))


def last_writes(writes: DataFrame, key: str, columns: list[str], sticky: list[str]) -> DataFrame:
    """One row for each key: the last values of the columns, the first non-null ones of the sticky columns."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return writes.groupBy(key).agg(*[F.max_by(c, "seq").alias(c) for c in columns], *[first(c) for c in sticky])
