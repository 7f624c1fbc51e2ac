"""Registered jobs: tasks, messages, commands, events."""

from pyspark.sql import functions as F

from harness.registry import job, moment
from mediaops import schemas as s
from mediaops.functions import rules
from mediaops.operators import commands, events, tasks
from mediaops.session import scratch
from mediaops.sources import tables

AS_OF = "1999-06-01 12:00:00"
FINAL = "('COMPLETED', 'CANCELLED', 'DEAD')"


@job("validate_renames", "fx_tasks", r"""
SELECT task_id, CASE WHEN task_name IS NULL OR NOT regexp_matches(task_name, '\S') OR length(task_name) > 255 THEN 10001 ELSE 0 END AS code,
  CASE WHEN task_name IS NULL OR NOT regexp_matches(task_name, '\S') OR length(task_name) > 255 THEN 'task_name' END AS field FROM fx_tasks""")
def _(v):
    ok, rejects = rules.validate(v("fx_tasks"), rules.rename_rules())
    passed = ok.select("task_id", F.lit(s.OK).alias("code"), F.lit(None).cast("string").alias("field"))
    return passed.unionByName(rejects.select("task_id", "code", "field"))


@job("skip_final_tasks", "fx_tasks", f"""
SELECT task_id, status FROM fx_tasks WHERE coalesce(status, '') NOT IN {FINAL}""")
def _(v):
    return tasks.skip_final_tasks(v("fx_tasks")).select("task_id", "status")


@job("lookup_many", "fx_tasks fx_task_events", """
, k AS (SELECT DISTINCT 'task_' || CAST(user_id * 103 AS VARCHAR) AS task_id FROM fx_task_events)
SELECT k.task_id, t.status, t.video_url, t.created_at, CASE WHEN t.task_id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS outcome
FROM k LEFT JOIN fx_tasks t ON k.task_id = t.task_id""")
def _(v):
    keys = v("fx_task_events").select(
        F.concat(F.lit("task_"), (F.col("user_id") * 103).cast("string")).alias("task_id")
    ).distinct()
    return tasks.lookup_many(
        v("fx_tasks").select("task_id", "status", "video_url", "created_at"), keys, "task_id"
    )


@job("task_board", "fx_tasks", f"""
, a AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1000000.0 AS age_s FROM fx_tasks)
SELECT task_id, CASE WHEN task_name <> '' THEN task_name ELSE list_last(string_split(video_url, '/')) END AS display_name,
  CASE status WHEN 'PENDING' THEN '等待中' WHEN 'QUEUED' THEN '排队中' WHEN 'PROCESSING' THEN '分析中' WHEN 'COMPLETED' THEN '已完成'
    WHEN 'FAILED' THEN '失败' WHEN 'RETRYING' THEN '重试中' WHEN 'DEAD' THEN '已终止' WHEN 'CANCELLED' THEN '已取消' ELSE '未知' END AS status_label,
  coalesce(progress, 0) AS progress,
  CASE WHEN age_s < 60 THEN 'now' WHEN age_s < 3600 THEN 'minutes' WHEN age_s < 86400 THEN 'hours' WHEN age_s < 604800 THEN 'days' ELSE 'date' END AS age,
  coalesce(status IN ('FAILED', 'DEAD'), false) AS can_retry, coalesce(status IN ('COMPLETED', 'FAILED', 'DEAD', 'CANCELLED'), false) AS can_delete
FROM a""")
def _(v):
    return tasks.task_board(v("fx_tasks"), moment(AS_OF))


@job("enrich_messages", "fx_tasks fx_task_events", f"""
SELECT e.seq, e.task_id, t.status AS task_status, CASE WHEN t.task_id IS NULL THEN 'DROP_UNKNOWN' WHEN t.status IN {FINAL} THEN 'SKIP_FINAL' ELSE 'PROCESS' END AS action
FROM (SELECT seq, 'task_' || CAST(user_id * 101 AS VARCHAR) AS task_id FROM fx_task_events) e LEFT JOIN fx_tasks t ON e.task_id = t.task_id""")
def _(v):
    messages = v("fx_task_events").select(
        "seq", F.concat(F.lit("task_"), (F.col("user_id") * 101).cast("string")).alias("task_id")
    )
    return tasks.enrich_messages(messages, v("fx_tasks"))


@job("classify_commands", "fx_commands fx_tasks", f"""
, c AS (SELECT seq, task_id, actor_id, CASE seq % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'delete' ELSE 'retry' END AS command FROM fx_commands)
SELECT c.seq, c.task_id, c.command, CASE WHEN t.task_id IS NULL THEN 21001 WHEN c.actor_id <> t.user_id THEN 23002 WHEN c.command = 'rename' THEN 0
  WHEN c.command = 'delete' AND t.status IN {FINAL} THEN 0 WHEN c.command = 'delete' AND t.status IS NOT NULL THEN 21005
  WHEN c.command = 'retry' AND t.status IN ('FAILED', 'DEAD') THEN 0 ELSE 21003 END AS code
FROM c LEFT JOIN fx_tasks t ON c.task_id = t.task_id""")
def _(v):
    kind = F.element_at(F.array(F.lit("rename"), F.lit("delete"), F.lit("retry")), (F.col("seq") % 3 + 1).cast("int"))
    asked = v("fx_commands").select("seq", "task_id", "actor_id", kind.alias("command"))
    return tasks.classify_commands(asked, v("fx_tasks")).select("seq", "task_id", "command", "code")


@job("unpublished_tasks", "fx_tasks fx_task_events", """
SELECT task_id, user_id, created_at FROM fx_tasks WHERE status = 'PENDING' AND task_id NOT IN (SELECT task_id FROM fx_task_events)""")
def _(v):
    return tasks.unpublished_tasks(v("fx_tasks"), v("fx_task_events")).select("task_id", "user_id", "created_at")


@job("task_status_rollup", "fx_tasks", """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, status, count(*) AS n,
  CAST(GROUPING(CAST(CAST(created_at AS DATE) AS VARCHAR), status) AS INT) AS level
FROM fx_tasks GROUP BY ROLLUP (CAST(CAST(created_at AS DATE) AS VARCHAR), status)""")
def _(v):
    return tasks.task_status_rollup(v("fx_tasks"))


@job("task_token_usage", "fx_tasks", """
SELECT user_id, ai_model, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS tasks FROM fx_tasks GROUP BY 1, 2""")
def _(v):
    return tasks.task_token_usage(v("fx_tasks"))


PROCESSING = """
, t AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS ms
  FROM fx_tasks WHERE started_at IS NOT NULL AND completed_at IS NOT NULL)
"""


@job("processing_time_stats", "fx_tasks", PROCESSING + """
SELECT day, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, max(ms) AS max, count(*) AS n FROM t GROUP BY day""")
def _(v):
    stats = tasks.processing_time_stats(v("fx_tasks"))
    return stats.withColumn("p50", F.round("p50", 3)).withColumn("p95", F.round("p95", 3))


@job("retry_health", "fx_tasks", """
SELECT user_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS tasks, avg(retry_count) AS mean_retries,
  avg(CASE WHEN retry_count >= max_retry THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_at_limit FROM fx_tasks GROUP BY 1, 2""")
def _(v):
    return tasks.retry_health(v("fx_tasks"))


PLACED = """
, placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id DESC) AS place FROM fx_tasks WHERE status <> 'CANCELLED')
"""


@job("list_user_tasks", "fx_tasks", PLACED + """
SELECT user_id, task_id, status, created_at, place FROM placed WHERE place > 3 AND place <= 6""")
def _(v):
    return tasks.list_all_users_tasks(v("fx_tasks"), page=2, size=3).select(
        "user_id", "task_id", "status", "created_at", F.col("place").cast("long").alias("place")
    )


@job("list_one_user_tasks", "fx_tasks", PLACED + """
SELECT user_id, task_id, status, created_at FROM placed
WHERE user_id = (SELECT min(user_id) FROM placed) AND place <= 20""")
def _(v):
    rows = v("fx_tasks")
    first = rows.filter("status <> 'CANCELLED'").agg(F.min("user_id")).first()[0]
    return tasks.list_user_tasks(rows, first, page=0, size=51).select("user_id", "task_id", "status", "created_at")


@job("page_info", "fx_tasks", """
SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 3.0) AS BIGINT) AS pages FROM fx_tasks WHERE status <> 'CANCELLED' GROUP BY user_id""")
def _(v):
    return tasks.page_info(v("fx_tasks"), size=3)


def _waiting(v):
    waiting = v("fx_tasks").filter(F.col("status").isin("PENDING", "QUEUED", "RETRYING"))
    return waiting.select(
        "task_id", (F.col("id") % 3 + 4).cast("int").alias("priority"),
        F.when(F.col("id") % 2 == 0, s.DEFAULT_ANALYSIS).alias("analysis_type"), F.col("created_at").alias("sent_at"),
    )


@job("backlog", "fx_tasks", f"""
SELECT CAST(id % 3 + 4 AS INT) AS priority, CASE WHEN id % 2 = 0 THEN 'FULL' END AS analysis_type, count(*) AS waiting, min(created_at) AS oldest,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(created_at))) // 1000 AS oldest_age_ms
FROM fx_tasks WHERE status IN ('PENDING', 'QUEUED', 'RETRYING') GROUP BY 1, 2""")
def _(v):
    return tasks.backlog(_waiting(v), moment(AS_OF))


@job("backlog_order", "fx_tasks", """
SELECT task_id, CAST(id % 3 + 4 AS INT) AS priority, created_at AS sent_at FROM fx_tasks WHERE status IN ('PENDING', 'QUEUED', 'RETRYING')
ORDER BY 2 DESC, 3, 1""")
def _(v):
    return tasks.backlog_order(_waiting(v)).select("task_id", "priority", "sent_at")


@job("stuck_tasks", "fx_tasks", f"""
SELECT task_id, started_at, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_at)) // 1000 AS stuck_ms FROM fx_tasks
WHERE status = 'PROCESSING' AND TIMESTAMP '{AS_OF}' - started_at > INTERVAL 30 MINUTE""")
def _(v):
    return tasks.stuck_tasks(v("fx_tasks"), moment(AS_OF)).select("task_id", "started_at", "stuck_ms")


MESSAGES = f"""
SELECT task_id, upload_id, user_id, video_url, 0 AS retry_count, TIMESTAMP '{AS_OF}' AS sent_at, 5 AS priority, 'FULL' AS analysis_type, prompt FROM fx_tasks WHERE status = 'PENDING'
UNION ALL SELECT task_id, NULL, user_id, video_url, 0, TIMESTAMP '{AS_OF}', 5, 'FULL', NULL FROM fx_tasks WHERE status = 'DEAD'
UNION ALL SELECT task_id, upload_id, user_id, video_url, retry_count + 1, TIMESTAMP '{AS_OF}', NULL, NULL, NULL FROM fx_tasks WHERE status = 'FAILED' AND retry_count < max_retry"""


def _outbound(v):
    rows, at = v("fx_tasks"), moment(AS_OF)
    retries, _ = tasks.route_failures(rows.filter("status = 'FAILED'"), at)
    return tasks.outbound_messages(
        tasks.submit_messages(rows.filter("status = 'PENDING'"), at),
        tasks.manual_retry_messages(rows.filter("status = 'DEAD'"), at),
        retries,
    )


@job("outbound_messages", "fx_tasks", MESSAGES)
def _(v):
    return _outbound(v)


@job("route_failures", "fx_tasks", f"""
SELECT task_id, CASE WHEN retry_count < max_retry THEN 'RETRY' ELSE 'DEAD' END AS route,
  CASE WHEN retry_count < max_retry THEN NULL ELSE coalesce(left(error_message, 500), '') END AS error,
  CASE WHEN retry_count < max_retry THEN retry_count + 1 ELSE retry_count END AS retry_count FROM fx_tasks WHERE status = 'FAILED'""")
def _(v):
    retries, dead = tasks.route_failures(v("fx_tasks").filter("status = 'FAILED'"), moment(AS_OF))
    again = retries.select("task_id", F.lit("RETRY").alias("route"), F.lit(None).cast("string").alias("error"), "retry_count")
    return again.unionByName(dead.select("task_id", F.lit("DEAD").alias("route"), "error", "retry_count"))


@job("snk_snapshot_upsert", "fx_tasks fx_task_events", f"""
, ch AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM (
    SELECT 'task_' || CAST(user_id * 101 AS VARCHAR) AS task_id, seq, status, retry_count FROM fx_task_events))
SELECT coalesce(t.task_id, ch.task_id) AS task_id, CASE WHEN ch.task_id IS NOT NULL THEN ch.status ELSE t.status END AS status,
  CASE WHEN ch.task_id IS NOT NULL THEN ch.retry_count ELSE t.retry_count END AS retry_count,
  CASE WHEN t.task_id IS NULL THEN TIMESTAMP '{AS_OF}' ELSE t.created_at END AS created_at,
  CASE WHEN ch.task_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE t.updated_at END AS updated_at
FROM fx_tasks t FULL JOIN (SELECT * FROM ch WHERE rn = 1) ch ON t.task_id = ch.task_id""")
def _(v):
    base = v("fx_tasks").select("task_id", "status", "retry_count", "created_at", "updated_at")
    changes = v("fx_task_events").select(
        F.concat(F.lit("task_"), (F.col("user_id") * 101).cast("string")).alias("task_id"),
        F.col("seq").alias("version"), "status", "retry_count",
    )
    path = scratch(v.spark, "snapshots")
    tables.write_snapshot(base, path, 0)
    # two batches, then the second one again
    handle = tables.snapshot_batches(path, ["task_id"], moment(AS_OF), 1)
    late = F.col("version") % 2 == 0
    for number, part in ((0, ~late), (1, late), (1, late)):
        newest = changes.groupBy("task_id").agg(F.max("version").alias("version"))
        handle(changes.join(newest, ["task_id", "version"]).filter(part), number)
    return tables.read_snapshot(v.spark, path)


# ---- the fold of commands ----

REPLAY = """
, c AS (SELECT c.*, t.user_id AS owner_id, row_number() OVER (PARTITION BY c.task_id ORDER BY c.ts, c.seq) AS rn
  FROM fx_commands c JOIN fx_tasks t ON c.task_id = t.task_id)
, st AS (
  SELECT task_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS command, status AS before, status, 0 AS applied,
    progress, retry_count, error_message, task_name, CAST(NULL AS VARCHAR) AS result, tokens_used, started_at, completed_at, updated_at FROM fx_tasks
  UNION ALL
  SELECT x.task_id, x.rn, x.seq, x.command, x.before,
    CASE WHEN x.ok = 0 THEN x.before ELSE CASE x.command WHEN 'compare_and_set' THEN x.new_status WHEN 'start' THEN 'PROCESSING' WHEN 'complete' THEN 'COMPLETED'
      WHEN 'fail' THEN 'FAILED' WHEN 'auto_retry' THEN 'RETRYING' WHEN 'mark_dead' THEN 'DEAD' WHEN 'manual_retry' THEN 'PENDING' WHEN 'delete' THEN 'CANCELLED' ELSE x.before END END,
    x.ok,
    CASE WHEN x.ok = 0 THEN x.s_progress WHEN x.command = 'progress' THEN x.progress WHEN x.command = 'complete' THEN 100 WHEN x.command = 'manual_retry' THEN 0 ELSE x.s_progress END,
    CASE WHEN x.ok = 0 THEN x.s_retry WHEN x.command = 'auto_retry' THEN x.s_retry + 1 WHEN x.command = 'manual_retry' THEN 0 ELSE x.s_retry END,
    CASE WHEN x.ok = 0 THEN x.s_error WHEN x.command IN ('fail', 'mark_dead') THEN left(x.error_message, 500) WHEN x.command = 'manual_retry' THEN NULL ELSE x.s_error END,
    CASE WHEN x.ok = 1 AND x.command = 'rename' THEN x.task_name ELSE x.s_name END,
    CASE WHEN x.command = 'complete' THEN x.result ELSE x.s_result END,
    CASE WHEN x.command = 'complete' THEN x.tokens_used ELSE x.s_tokens END,
    CASE WHEN x.ok = 1 AND x.command = 'start' THEN x.ts WHEN x.ok = 1 AND x.command = 'manual_retry' THEN NULL ELSE x.s_started END,
    CASE WHEN x.command = 'complete' THEN x.ts WHEN x.ok = 1 AND x.command = 'manual_retry' THEN NULL ELSE x.s_completed END,
    CASE WHEN x.ok = 1 THEN x.ts ELSE x.s_updated END
  FROM (
    SELECT c.*, st.status AS before, st.progress AS s_progress, st.retry_count AS s_retry, st.error_message AS s_error, st.task_name AS s_name,
      st.result AS s_result, st.tokens_used AS s_tokens, st.started_at AS s_started, st.completed_at AS s_completed, st.updated_at AS s_updated,
      CASE WHEN c.command = 'compare_and_set' THEN CASE WHEN st.status = c.old_status THEN 1 ELSE 0 END
        WHEN c.command = 'start' THEN CASE WHEN st.status IN ('QUEUED', 'RETRYING') THEN 1 ELSE 0 END
        WHEN c.command = 'rename' THEN CASE WHEN c.actor_id = c.owner_id THEN 1 ELSE 0 END
        WHEN c.command = 'manual_retry' THEN CASE WHEN c.actor_id = c.owner_id AND st.status IN ('FAILED', 'DEAD') THEN 1 ELSE 0 END
        WHEN c.command = 'delete' THEN CASE WHEN c.actor_id = c.owner_id AND st.status IN ('COMPLETED', 'DEAD', 'CANCELLED') THEN 1 ELSE 0 END
        ELSE 1 END AS ok
    FROM st JOIN c ON c.task_id = st.task_id AND c.rn = st.rn + 1) x)
"""


def _fold_inputs(v):
    rows = v("fx_tasks").withColumn("result", F.lit(None).cast("string")).withColumn(
        "summary", F.lit(None).cast("string")
    ).withColumn("frame_count", F.lit(None).cast("int"))
    return rows, v("fx_commands")


def _outcome(kind):
    @job(f"cmd_{kind}", "fx_tasks fx_commands", REPLAY + f"""
SELECT task_id, seq, before AS status_before, status AS status_after, applied FROM st WHERE command = '{kind}'
UNION ALL SELECT task_id, seq, NULL, NULL, 0 FROM fx_commands WHERE command = '{kind}' AND task_id NOT IN (SELECT task_id FROM fx_tasks)""")
    def _(v):
        outcomes = commands.replay_commands(*_fold_inputs(v), slice_seconds=86400)
        return outcomes.filter(F.col("command") == kind).select(
            "task_id", "seq", "status_before", "status_after", "applied"
        )


for _kind in commands.COMMANDS:
    _outcome(_kind)


# All commands, in finer slices.
@job("replay_large_tasks", "fx_tasks fx_commands", REPLAY + """
SELECT task_id, seq, command, before AS status_before, status AS status_after, applied FROM st WHERE command IS NOT NULL
UNION ALL SELECT task_id, seq, command, NULL, NULL, 0 FROM fx_commands WHERE task_id NOT IN (SELECT task_id FROM fx_tasks)""")
def _(v):
    outcomes = commands.replay_commands(*_fold_inputs(v), slice_seconds=3600)
    return outcomes.select("task_id", "seq", "command", "status_before", "status_after", "applied")


@job("apply_commands", "fx_tasks fx_commands", REPLAY + """
, fin AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rn DESC) AS back FROM st)
SELECT task_id, status, progress, retry_count, error_message, task_name, result, tokens_used, started_at, completed_at, updated_at FROM fin WHERE back = 1""")
def _(v):
    after, _ = commands.apply_commands(*_fold_inputs(v), slice_seconds=86400)
    return after.select(
        "task_id", "status", "progress", "retry_count", "error_message", "task_name", "result",
        "tokens_used", "started_at", "completed_at", "updated_at",
    )


# ---- events ----

@job("transition_audit", "fx_task_events", """
, p AS (SELECT seq, task_id, lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq) AS from_status, status AS to_status FROM fx_task_events)
SELECT *, CASE WHEN from_status IS NULL OR from_status = to_status THEN true ELSE (from_status || '>' || to_status) IN (
  'PENDING>QUEUED', 'PENDING>CANCELLED', 'QUEUED>PROCESSING', 'QUEUED>CANCELLED', 'PROCESSING>COMPLETED', 'PROCESSING>FAILED', 'PROCESSING>CANCELLED',
  'FAILED>RETRYING', 'FAILED>DEAD', 'RETRYING>PROCESSING', 'RETRYING>FAILED', 'RETRYING>DEAD') END AS legal FROM p""")
def _(v):
    return events.transition_audit(v("fx_task_events"), slice_seconds=86400).select(
        "seq", "task_id", "from_status", "to_status", "legal"
    )


@job("state_dwell", "fx_task_events", """
SELECT seq, task_id, status, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000 AS dwell_ms FROM fx_task_events
WINDOW w AS (PARTITION BY task_id ORDER BY ts, seq)""")
def _(v):
    return events.state_dwell(v("fx_task_events"), slice_seconds=86400).select("seq", "task_id", "status", "dwell_ms")
