"""State machines over events, in batch."""

from pyspark.sql import functions as F

from clausemill.operators import states as s

from .registry import query

_c = F.col


@query("X1_rate_limit", """WITH RECURSIVE e AS (SELECT event_id AS id, user_id % 20 AS user_id, epoch(TIMESTAMP '2024-01-01') + event_id * 3 AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
    r AS (SELECT id, user_id, n, true AS allowed, [t] AS held FROM e WHERE n = 1 UNION ALL
      SELECT e.id, e.user_id, e.n, len(list_filter(r.held, lambda x: e.t - x < 60)) < 5, CASE WHEN len(list_filter(r.held, lambda x: e.t - x < 60)) < 5 THEN list_append(list_filter(r.held, lambda x: e.t - x < 60), e.t) ELSE list_filter(r.held, lambda x: e.t - x < 60) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT id, allowed FROM r""")
def _(v):
    t = v.events.select(_c("event_id").alias("id"), (_c("user_id") % 20).alias("user_id"), F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + _c("event_id") * 3).alias("ts"))
    return s.rate_limited(t)


_Q = "(SELECT event_id AS id, user_id % 300 AS user_id, ts FROM events)"


@query("X2_daily_quota", f"WITH t AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, id) AS mine FROM {_Q}), g AS (SELECT *, coalesce(sum(CASE WHEN mine <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT id, CASE WHEN before >= 80 THEN -1 WHEN mine > 5 THEN -2 ELSE 1 END AS outcome FROM g")
def _(v):
    return s.daily_quota(v.events.select(_c("event_id").alias("id"), (_c("user_id") % 300).alias("user_id"), "ts"))


@query("X3_in_flight", "WITH t AS (SELECT event_id AS id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER w AS total, user_id, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT id, (total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)))::BIGINT AS held FROM t")
def _(v):
    return s.in_flight(v.events.select(_c("event_id").alias("id"), "user_id", "ts", F.when(_c("event_type").isin("view", "click"), 1).otherwise(-1).alias("change")))


@query("X4_sessions", "SELECT event_id AS id, active, active <= 5 AS allowed FROM (SELECT event_id, len(list_distinct(list(event_id % 9) OVER (PARTITION BY user_id % 20 ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW)))::BIGINT AS active FROM events)")
def _(v):
    return s.sessions(v.events.select(_c("event_id").alias("id"), (_c("user_id") % 20).alias("user_id"), (_c("event_id") % 9).alias("key"), "ts"))


_JOBS = "jobs AS (SELECT job_id, min(document_id) AS document_id, min(user_id) AS user_id, coalesce(arg_max(event, {'t': ts, 's': seq}) FILTER (event <> 'heartbeat'), 'queued') AS status, min(ts) AS created_at, max(ts) FILTER (event = 'running') AS started_at, max(ts) AS updated_at FROM job_events GROUP BY job_id)"


@query("J15_queue_ahead", f"WITH {_JOBS} SELECT job_id, (rank() OVER (ORDER BY created_at) - 1)::BIGINT AS ahead FROM jobs WHERE status = 'queued'")
def _(v):
    return s.queue_ahead(s.jobs(v.job_events).where("status = 'queued'"))


@query("X5_claim", f"WITH {_JOBS}, r AS (SELECT user_id, count(*) AS mine FROM jobs WHERE status = 'running' GROUP BY user_id), q AS (SELECT job_id, rank() OVER (ORDER BY created_at) - 1 AS ahead FROM jobs WHERE status = 'queued'), x AS (SELECT job_id, coalesce(ahead, 0)::BIGINT AS queue_ahead, CASE WHEN status <> 'queued' THEN status WHEN (SELECT count(*) FROM jobs WHERE status = 'running') >= 1000000 OR coalesce(mine, 0) >= 2 THEN 'slots_busy' ELSE 'claimed' END AS reason FROM jobs LEFT JOIN r USING (user_id) LEFT JOIN q USING (job_id)) SELECT job_id, reason = 'claimed' AS claimed, queue_ahead, reason FROM x")
def _(v):
    return s.claims(s.jobs(v.job_events), 1_000_000, 2)


@query("X6_job_end", f"WITH {_JOBS} SELECT job_id, status, updated_at AS finished_at FROM jobs WHERE status IN ('completed', 'failed')")
def _(v):
    return s.jobs(v.job_events).where("status IN ('completed', 'failed')").select("job_id", "status", _c("updated_at").alias("finished_at"))


@query("X7_lost_jobs", f"WITH {_JOBS}, n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events) SELECT job_id, CASE WHEN updated_at < now - INTERVAL 15 MINUTE THEN 'orphan' ELSE 'stale' END AS reason FROM jobs, n WHERE status = 'running' AND (updated_at < now - INTERVAL 15 MINUTE OR started_at < now - INTERVAL 90 MINUTE)")
def _(v):
    now = v.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))  # one row
    return s.lost(s.jobs(v.job_events).crossJoin(F.broadcast(now)), _c("now"))


@query("J36_latest_job", f"WITH {_JOBS}, l AS (SELECT document_id, arg_max({{'job_id': job_id, 'status': status}}, {{'t': created_at, 'j': job_id}}) AS j FROM jobs GROUP BY document_id) SELECT document_id, j.job_id AS job_id FROM l JOIN docs ON docs.id = document_id WHERE docs.status IN ('pdf_processing', 'admin_processing', 'pending_admin_review') AND j.status = 'failed'")
def _(v):
    return s.failed_documents(v.docs, s.jobs(v.job_events))


@query("X8_ask_queue", f"WITH {_JOBS}, n AS (SELECT max(ts) AS now FROM events) SELECT job_id, CASE WHEN status IN ('queued', 'running') AND created_at < now - INTERVAL 3600 SECOND THEN 'expired' WHEN status = 'queued' AND created_at < now - INTERVAL 600 SECOND THEN 'slot_timeout' ELSE status END AS status FROM jobs, n")
def _(v):
    now = v.events.agg(F.max("ts").alias("now"))  # one row
    j = s.jobs(v.job_events).crossJoin(F.broadcast(now))
    old = lambda n: _c("created_at") < _c("now") - F.expr(f"INTERVAL {n} SECONDS")
    return j.select("job_id", F.when(_c("status").isin("queued", "running") & old(3600), "expired").when((_c("status") == "queued") & old(600), "slot_timeout").otherwise(_c("status")).alias("status"))


@query("X10_payment_sync", "SELECT subscription_id, CASE WHEN e.type = 'deleted' OR NOT e.paid THEN 'cancelled' ELSE 'active' END AS status, e.cents / 100 AS price FROM (SELECT user_id AS subscription_id, arg_max({'type': CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'updated' END, 'paid': event_id % 3 <> 0, 'cents': event_id % 5000}, event_id) AS e FROM events GROUP BY user_id)")
def _(v):
    return s.payments(v.events.select(_c("user_id").alias("subscription_id"), _c("event_id").alias("seq"), F.when(_c("event_type") == "error", "deleted").otherwise("updated").alias("type"), (_c("event_id") % 3 != 0).alias("paid"), (_c("event_id") % 5000).alias("cents")))


@query("X11_upload_progress", "SELECT user_id, arg_max(stage, seq) AS stage, arg_min(owner, seq) FILTER (owner IS NOT NULL) AS owner FROM (SELECT event_id AS seq, user_id, event_type AS stage, CASE WHEN event_id % 4 = 1 THEN event_id % 7 END AS owner FROM events) GROUP BY user_id")
def _(v):
    t = v.events.select(_c("event_id").alias("seq"), "user_id", _c("event_type").alias("stage"), F.when(_c("event_id") % 4 == 1, _c("event_id") % 7).alias("owner"))
    return s.last_writes(t, "user_id", ["stage"], ["owner"])


@query("X13_catalog_upsert", "SELECT id, arg_max(name, seq) AS name, arg_max(amount, seq) AS amount FROM (SELECT event_id % 97 AS id, event_id AS seq, concat(event_type, '-', event_id % 11) AS name, event_id % 900 AS amount FROM events) GROUP BY id")
def _(v):
    t = v.events.select((_c("event_id") % 97).alias("id"), _c("event_id").alias("seq"), F.concat_ws("-", "event_type", (_c("event_id") % 11).cast("string")).alias("name"), (_c("event_id") % 900).alias("amount"))
    return s.last_writes(t, "id", ["name", "amount"], [])
