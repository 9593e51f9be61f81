"""The state machines over events as Structured Streaming queries.

Each is the streaming form of a batch plan in operators.states; state is kept for a user, a job or a window and ends by
the watermark or a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausemill.operators.states import ATTEMPTS, IDLE_MINUTES, SECONDS, admit


def rate_limited(attempts: DataFrame) -> DataFrame:
    """id, allowed of a stream of attempts(id, user_id, ts). State: the last few times of each user; it ends when the
    watermark has left the window. Inside a micro-batch, a user's attempts are taken in order."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recorded = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        times = [t.timestamp() for t in rows["ts"]]
        allowed = [admit(recorded, t) for t in times]
        state.update((recorded,))
        state.setTimeoutTimestamp(int((max(times) + SECONDS) * 1000) + 1)
        yield pd.DataFrame({"id": rows["id"], "allowed": allowed})

    watched = attempts.withWatermark("ts", f"{SECONDS} seconds")
    return watched.groupBy("user_id").applyInPandasWithState(fold, "id long, allowed boolean", "recorded array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def attempts_by_window(attempts: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """user_id, start, n: attempts of each user in fixed windows; late ones count until the watermark passes. Without
    `late` the stream has a watermark already."""
    w = F.window("ts", f"{SECONDS} seconds")
    watched = attempts if late is None else attempts.withWatermark("ts", late)
    return watched.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def sessions(seen: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that end after the idle time."""
    w = F.session_window("ts", f"{IDLE_MINUTES} minutes")
    return seen.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status, updated_at: the last status of each job, updated with every micro-batch."""
    status = F.max_by(F.when(F.col("event") != "heartbeat", F.col("event")), F.when(F.col("event") != "heartbeat", F.struct("ts", "seq")))
    return events.groupBy("job_id").agg(F.coalesce(status, F.lit("queued")).alias("status"), F.max("ts").alias("updated_at"))


def once_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without those that repeat an id while the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def upsert_latest(events: DataFrame, key: str, path: str, checkpoint: str):
    """Keeps the last row of each key, by seq, in a Parquet table, written anew in a folder for each micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = batch if n == 0 else spark.read.parquet(f"{path}/{n - 1}").unionByName(batch)
        last = held.groupBy(key).agg(F.max_by(F.struct(*[c for c in held.columns if c != key]), "seq").alias("x")).select(key, "x.*")
        last.write.mode("overwrite").parquet(f"{path}/{n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


__all__ = ["ATTEMPTS", "attempts_by_window", "job_states", "once_each", "rate_limited", "sessions", "upsert_latest"]
