"""Streams against the batch plans over the same events."""

import datetime


from clausemill.operators import states
from clausemill.streaming import limits

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, make, mode):
    """Rows of a stream that gets one file for each batch, in order."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(source / f"{i:03d}.parquet")
        (source / f"{i:03d}.parquet").touch()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_rate_limit(spark, tmp_path):
    rows = [(i, i % 2, at(3 * i)) for i in range(60)]
    schema = "id long, user_id long, ts timestamp"
    found = streamed(spark, tmp_path, [rows[:25], rows[25:40], rows[40:]], schema, limits.rate_limited, "append")
    batch = states.rate_limited(spark.createDataFrame(rows, schema)).collect()
    assert {r.id: r.allowed for r in found} == {r.id: r.allowed for r in batch}
    assert 0 < sum(r.allowed for r in batch) < 60


def test_job_states(spark, tmp_path):
    names = ["queued", "running", "heartbeat", "completed", "heartbeat", "failed"]
    rows = [(i, i % 4, 0, 0, at(i), names[i % 6]) for i in range(40)]
    schema = "seq long, job_id long, document_id long, user_id long, ts timestamp, event string"
    found = streamed(spark, tmp_path, [rows[:15], rows[15:]], schema, limits.job_states, "complete")
    assert {r.job_id: r.status for r in found} == {r.job_id: r.status for r in states.jobs(spark.createDataFrame(rows, schema)).collect()}


def test_sessions_end_after_the_idle_time(spark, tmp_path):
    rows = [(1, at(0)), (1, at(600)), (1, at(4000)), (2, at(100))]
    late = [(9, at(100_000))]  # moves the watermark
    found = streamed(spark, tmp_path, [rows, late, [(9, at(100_001))]], "user_id long, ts timestamp", limits.sessions, "append")
    assert sorted((r.user_id, r.n) for r in found) == [(1, 1), (1, 2), (2, 1)]


def test_windows_and_repeats(spark, tmp_path):
    rows = [(1, 5, at(1)), (1, 5, at(1)), (2, 5, at(30)), (3, 5, at(90))]
    schema = "id long, user_id long, ts timestamp"
    found = streamed(spark, tmp_path, [rows, [(4, 5, at(100_000))], [(5, 5, at(100_001))]], schema, lambda s: limits.attempts_by_window(limits.once_each(s), None), "append")
    assert sorted((r.start.second + 60 * r.start.minute, r.n) for r in found) == [(0, 2), (60, 1)]


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    schema = "id long, seq long, name string"
    source = tmp_path / "in"
    for i, rows in enumerate([[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c"), (3, 4, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    limits.upsert_latest(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name))
    assert sorted((r.id, r.name) for r in spark.read.parquet(str(last)).collect()) == [(1, "c"), (2, "b"), (3, "d")]
