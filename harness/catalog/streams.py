"""Registered jobs: streams over one table read as a file source in several batches, run to its end.

The oracle is the batch form. Where a stream holds results back until the watermark passes, the
oracle leaves out what is still open.
"""

from contextlib import contextmanager

from pyspark.sql import functions as F

from harness import fixtures
from harness.registry import job
from mediaops.session import scratch
from mediaops.sources import topics
from mediaops.streaming import jobs, state

@contextmanager
def _local_state(v):
    """A local session needs no more state stores than cores; a cluster keeps its setting."""
    setting = "spark.sql.shuffle.partitions"
    before = v.spark.conf.get(setting)
    if v.spark.sparkContext.master.startswith("local"):
        v.spark.conf.set(setting, str(min(int(before), v.cores)))
    try:
        yield
    finally:
        v.spark.conf.set(setting, before)


def _run(v, stream, ntz=(), idle_batches=True):
    path, progress = scratch(v.spark, "stream"), scratch(v.spark, "progress")
    with _local_state(v):
        jobs.start(stream, path, progress, available_now=True, idle_batches=idle_batches).awaitTermination()
    out = v.spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
    for column in ntz:
        out = out.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return out


def _stream(v, name):
    return fixtures.stream(v.spark, v.sf_dir, name)


@job("st_dedup_messages", "fx_task_events", "SELECT DISTINCT task_id, retry_count FROM fx_task_events")
def _(v):
    return _run(v, jobs.dedup_messages(_stream(v, "fx_task_events"), "ts", "1000 hours").select("task_id", "retry_count"))


@job("st_event_counts", "fx_task_events", """
SELECT date_trunc('day', ts) AS window_start, status, count(*) AS n FROM fx_task_events GROUP BY 1, 2
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx_task_events)""")
def _(v):
    counts = jobs.event_counts(_stream(v, "fx_task_events"), "status", "ts", "1 day")
    return _run(v, counts, ntz=["window_start"]).drop("window_end")


@job("st_rate_sliding", "fx_requests", """
, w AS (SELECT user_id, date_trunc('day', ts) - INTERVAL 1 DAY * CAST(g.i AS INT) AS window_start FROM fx_requests, generate_series(0, 1) AS g(i))
SELECT window_start, user_id, count(*) AS n FROM w GROUP BY 1, 2
HAVING window_start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM fx_requests)""")
def _(v):
    hops = jobs.rate_sliding(_stream(v, "fx_requests"), "user_id", "ts", "2 days", "1 day")
    return _run(v, hops, ntz=["window_start"]).drop("window_end")


# Attempts that start, start after the bound, and never start.
@job("st_queue_latency", "fx_task_events", """
, m AS (SELECT task_id, seq AS attempt, ts AS sent_at, CASE WHEN seq % 7 <> 0 THEN ts + INTERVAL 1 MINUTE * (seq % 90) END AS started_at FROM fx_task_events)
, wm AS (SELECT least(max(sent_at), max(started_at)) - INTERVAL 10 MINUTE AS at FROM m)
SELECT task_id, attempt, CASE WHEN started_at <= sent_at + INTERVAL 1 HOUR THEN (epoch_ms(started_at) - epoch_ms(sent_at)) END AS latency_ms
FROM m, wm WHERE started_at <= sent_at + INTERVAL 1 HOUR OR sent_at + INTERVAL 1 HOUR < wm.at""")
def _(v):
    sent = _stream(v, "fx_task_events").select("task_id", F.col("seq").alias("attempt"), F.col("ts").alias("sent_at"))
    began = _stream(v, "fx_task_events").filter("seq % 7 <> 0").select(
        "task_id", F.col("seq").alias("attempt"),
        (F.col("ts") + F.expr("INTERVAL '1' MINUTE * (seq % 90)")).alias("started_at"),
    )
    return _run(v, jobs.queue_latency(sent, began)).select("task_id", "attempt", "latency_ms")


@job("st_task_state", "fx_task_events", """
, p AS (SELECT task_id, seq, lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq) AS from_status, status AS to_status FROM fx_task_events)
SELECT *, CASE WHEN from_status IS NULL OR from_status = to_status THEN true ELSE (from_status || '>' || to_status) IN (
  'PENDING>QUEUED', 'PENDING>CANCELLED', 'QUEUED>PROCESSING', 'QUEUED>CANCELLED', 'PROCESSING>COMPLETED', 'PROCESSING>FAILED', 'PROCESSING>CANCELLED',
  'FAILED>RETRYING', 'FAILED>DEAD', 'RETRYING>PROCESSING', 'RETRYING>FAILED', 'RETRYING>DEAD') END AS legal FROM p""")
def _(v):
    return _run(v, state.task_state(_stream(v, "fx_task_events"), keep_hours=24 * 366))


@job("st_stuck_alerts", "fx_task_events", """
, p AS (SELECT task_id, status, epoch_us(ts) // 1000 AS ms, epoch_us(lead(ts) OVER (PARTITION BY task_id ORDER BY ts, seq)) // 1000 AS next_ms FROM fx_task_events)
SELECT task_id, make_timestamp(ms * 1000) AS since FROM p WHERE status = 'PROCESSING'
  AND (next_ms - ms > 1800000 OR (next_ms IS NULL AND ms + 1800000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM fx_task_events)))""")
def _(v):
    return _run(v, state.stuck_alerts(_stream(v, "fx_task_events")), ntz=["since"]).select("task_id", "since")


@job("st_upload_progress", "fx_chunk_acks fx_chunk_sessions", """
, c AS (SELECT a.upload_id, s.total_chunks, list_sort(list(DISTINCT a.chunk_index) FILTER (WHERE a.chunk_index BETWEEN 0 AND s.total_chunks - 1)) AS idx
  FROM fx_chunk_acks a JOIN fx_chunk_sessions s ON a.upload_id = s.upload_id GROUP BY 1, 2)
SELECT upload_id, coalesce(array_to_string(idx, ','), '') AS chunks, CAST(coalesce(len(idx), 0) AS INT) AS done,
  CASE WHEN total_chunks > 0 THEN CAST(floor(coalesce(len(idx), 0) * 100.0 / total_chunks) AS INT) ELSE 0 END AS progress FROM c""")
def _(v):
    sessions = v("fx_chunk_sessions").select("upload_id", "total_chunks")
    acks = _stream(v, "fx_chunk_acks").join(sessions, "upload_id")
    done = state.newest_progress(_run(v, state.upload_progress(acks), idle_batches=False))
    return done.withColumn("chunks", F.array_join("chunks", ","))


@job("st_upload_sessions", "fx_chunk_acks", """
, g AS (SELECT upload_id, acked_at, CASE WHEN acked_at - lag(acked_at) OVER w > INTERVAL 252 HOUR THEN 1 ELSE 0 END AS cut FROM fx_chunk_acks WINDOW w AS (PARTITION BY upload_id ORDER BY acked_at))
, n AS (SELECT *, sum(cut) OVER (PARTITION BY upload_id ORDER BY acked_at RANGE UNBOUNDED PRECEDING) AS burst FROM g)
SELECT upload_id, min(acked_at) AS first_at, max(acked_at) AS last_at, count(*) AS acks FROM n GROUP BY upload_id, burst
HAVING max(acked_at) + INTERVAL 252 HOUR <= (SELECT max(acked_at) - INTERVAL 1 HOUR FROM fx_chunk_acks)""")
def _(v):
    bursts = jobs.upload_bursts(_stream(v, "fx_chunk_acks"), gap="252 hours")
    return _run(v, bursts, ntz=["first_at", "last_at"]).drop("ended_at")


LETTERS = """
, l AS (SELECT task_id, retry_count, 'e' || CAST(seq % 5 AS VARCHAR) AS error, ts AS sent_at,
  row_number() OVER (PARTITION BY task_id, retry_count ORDER BY ts, 'e' || CAST(seq % 5 AS VARCHAR)) AS rn FROM fx_task_events WHERE status = 'FAILED')
SELECT task_id, retry_count, error, sent_at FROM l WHERE rn = 1"""


def _letters(v):
    return _stream(v, "fx_task_events").filter("status = 'FAILED'").select(
        "task_id", "retry_count", F.concat(F.lit("e"), (F.col("seq") % 5).cast("string")).alias("error"),
        F.col("ts").alias("sent_at"), "seq",
    )


def _dead_letter_table(v, *parts):
    """The letters of each part taken in under a checkpoint of its own, into one table."""
    path = scratch(v.spark, "dead-letters")
    for part in parts:
        with _local_state(v):
            jobs.append_dead_letters(
                _letters(v).filter(part), path, scratch(v.spark, "progress"), available_now=True
            ).awaitTermination()
    return v.spark.read.schema(jobs.LETTER).parquet(path).select("task_id", "retry_count", "error", "sent_at")


@job("st_dead_letters", "fx_task_events", LETTERS)
def _(v):
    return _dead_letter_table(v, F.lit(True))


# Two runs, the later letters first: the second finds keys that are stored, and keys that are not.
@job("snk_dead_letter_table", "fx_task_events", """
, l AS (SELECT task_id, retry_count, 'e' || CAST(seq % 5 AS VARCHAR) AS error, ts AS sent_at,
  row_number() OVER (PARTITION BY task_id, retry_count ORDER BY CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END, ts, 'e' || CAST(seq % 5 AS VARCHAR)) AS rn
  FROM fx_task_events WHERE status = 'FAILED')
SELECT task_id, retry_count, error, sent_at FROM l WHERE rn = 1""")
def _(v):
    return _dead_letter_table(v, F.col("seq") % 3 == 0, F.col("seq") % 3 != 0)


@job("st_retry_loop", "fx_task_events fx_tasks", """
SELECT e.task_id, CASE WHEN t.retry_count < t.max_retry THEN 'RETRY' ELSE 'DEAD' END AS route,
  CASE WHEN t.retry_count < t.max_retry THEN t.retry_count + 1 ELSE t.retry_count END AS retry_count, date_trunc('milliseconds', e.ts) AS sent_at
FROM fx_task_events e JOIN fx_tasks t ON e.task_id = t.task_id WHERE e.status = 'FAILED'""")
def _(v):
    failures = _stream(v, "fx_task_events").filter("status = 'FAILED'").select(
        "task_id", F.lit("broken").alias("error_message"), F.col("ts").alias("sent_at")
    )
    retry_path, dead_path = scratch(v.spark, "retry"), scratch(v.spark, "dead")
    with _local_state(v):
        jobs.retry_loop(
            failures, v("fx_tasks"), {"format": "text", "path": retry_path}, {"format": "text", "path": dead_path},
            scratch(v.spark, "progress"), available_now=True,
        ).awaitTermination()
    retries = topics.read_task_messages(v.spark, {"format": "text", "path": retry_path}, streaming=False)
    dead = topics.read_dead_letters(v.spark, {"format": "text", "path": dead_path}, streaming=False)
    columns = ["task_id", "route", "retry_count", F.col("sent_at").cast("timestamp_ntz").alias("sent_at")]
    return retries.withColumn("route", F.lit("RETRY")).select(*columns).unionByName(
        dead.withColumn("route", F.lit("DEAD")).select(*columns)
    )
