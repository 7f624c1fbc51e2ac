"""Registered jobs: rates, quotas, call log."""

from pyspark.sql import functions as F

from harness.registry import job, moment
from mediaops.operators import costs, limits, quotas
from mediaops.operators.tasks import percentiles

DAY = 86400


@job("rate_global", "fx_requests", """
SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS window_start, count(*) AS n FROM fx_requests GROUP BY 1
HAVING count(*) > (SELECT count(*) / 30 FROM fx_requests)""")
def _(v):
    requests = v("fx_requests")
    return limits.rate_global(requests, limit=requests.count() // 30, seconds=DAY)


@job("rate_user_aligned", "fx_requests", """
, p AS (SELECT req_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, req_id) AS place FROM fx_requests)
SELECT *, place <= 4 AS allowed FROM p""")
def _(v):
    return limits.rate_aligned(v("fx_requests"), ["user_id"], limit=4, seconds=DAY).select(
        "req_id", "user_id", "place", "allowed"
    )


@job("rate_endpoint", "fx_requests", """
, p AS (SELECT req_id, user_id, endpoint, row_number() OVER (PARTITION BY user_id, endpoint, date_trunc('day', ts) ORDER BY ts, req_id) AS place FROM fx_requests)
SELECT *, place <= 2 AS allowed FROM p""")
def _(v):
    return limits.rate_aligned(v("fx_requests"), ["user_id", "endpoint"], limit=2, seconds=DAY).select(
        "req_id", "user_id", "endpoint", "place", "allowed"
    )


ANCHORED = """
, r AS (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY ts, req_id) AS rn FROM fx_requests WHERE api_key IS NOT NULL)
, st AS (
  SELECT api_key, rn, req_id, ts AS window_start, CAST(1 AS BIGINT) AS place FROM r WHERE rn = 1
  UNION ALL
  SELECT r.api_key, r.rn, r.req_id, CASE WHEN r.ts >= st.window_start + INTERVAL 1 DAY THEN r.ts ELSE st.window_start END,
    CASE WHEN r.ts >= st.window_start + INTERVAL 1 DAY THEN 1 ELSE st.place + 1 END
  FROM st JOIN r ON r.api_key = st.api_key AND r.rn = st.rn + 1)
SELECT req_id, api_key, window_start, place, place <= 4 AS allowed FROM st
UNION ALL SELECT req_id, api_key, NULL, NULL, true FROM fx_requests WHERE api_key IS NULL"""


@job("rate_user_anchored", "fx_requests", ANCHORED)
def _(v):
    return limits.rate_anchored(
        v("fx_requests"), "api_key", limit=4, seconds=DAY, slice_seconds=5 * DAY
    ).select("req_id", "api_key", "window_start", "place", "allowed")


# The same requests in finer slices.
@job("rate_user_anchored_long_bursts", "fx_requests", ANCHORED)
def _(v):
    return limits.rate_anchored(
        v("fx_requests"), "api_key", limit=4, seconds=DAY, slice_seconds=2 * DAY
    ).select("req_id", "api_key", "window_start", "place", "allowed")


@job("sliding_rate", "fx_requests", """
, p AS (SELECT req_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM fx_requests)
SELECT *, in_window > 4 AS over_limit FROM p""")
def _(v):
    return limits.sliding_rate(v("fx_requests"), ["user_id"], limit=4, seconds=DAY).select(
        "req_id", "user_id", "in_window", "over_limit"
    )


# ---- quotas ----

@job("quota_remaining", "fx_quotas", """
, r AS (SELECT user_id, CASE WHEN quota_daily IS NULL OR used_daily IS NULL THEN quota_daily ELSE greatest(0, quota_daily - used_daily) END AS remaining_daily,
  CASE WHEN quota_monthly IS NULL OR used_monthly IS NULL THEN quota_monthly ELSE greatest(0, quota_monthly - used_monthly) END AS remaining_monthly FROM fx_quotas)
SELECT *, coalesce(remaining_daily >= 50 AND remaining_monthly >= 50, false) AS enough FROM r""")
def _(v):
    return quotas.quota_remaining(v("fx_quotas"), F.lit(50)).select(
        "user_id", "remaining_daily", "remaining_monthly", "enough"
    )


@job("quota_reset", "fx_quotas", """
, q AS (SELECT *, reset_daily_at IS NULL OR reset_daily_at < TIMESTAMP '2024-01-15 10:00:00' AS d, reset_monthly_at IS NULL OR reset_monthly_at < TIMESTAMP '2024-01-15 10:00:00' AS m FROM fx_quotas)
SELECT user_id, CASE WHEN d THEN 0 ELSE used_daily END AS used_daily, CASE WHEN m THEN 0 ELSE used_monthly END AS used_monthly,
  CASE WHEN d THEN TIMESTAMP '2024-01-16' ELSE reset_daily_at END AS reset_daily_at, CASE WHEN m THEN TIMESTAMP '2024-02-01' ELSE reset_monthly_at END AS reset_monthly_at FROM q""")
def _(v):
    return quotas.quota_reset(v("fx_quotas"), moment("2024-01-15 10:00:00")).select(
        "user_id", "used_daily", "used_monthly", "reset_daily_at", "reset_monthly_at"
    )


@job("quota_running_usage", "fx_ai_calls", """
, p AS (SELECT id, user_id, total_tokens,
    CAST(sum(total_tokens) OVER (PARTITION BY user_id, date_trunc('day', created_at) ORDER BY created_at, id) AS BIGINT) AS day_tokens,
    CAST(sum(total_tokens) OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, id) AS BIGINT) AS month_tokens FROM fx_ai_calls)
SELECT id, user_id, day_tokens, month_tokens, day_tokens > 60 AND day_tokens - total_tokens <= 60 AS crosses_daily,
  month_tokens > 600 AND month_tokens - total_tokens <= 600 AS crosses_monthly FROM p""")
def _(v):
    return quotas.quota_running_usage(v("fx_ai_calls"), daily=60, monthly=600).select(
        "id", "user_id", "day_tokens", "month_tokens", "crosses_daily", "crosses_monthly"
    )


QUOTA_REPLAY = """
, c AS (SELECT c.id, c.user_id, CAST(c.created_at AS DATE) AS day, date_trunc('month', c.created_at) AS month, c.total_tokens AS tok,
    coalesce(q.quota_daily, 500) AS qd, coalesce(q.quota_monthly, 10000) AS qm,
    row_number() OVER (PARTITION BY c.user_id, date_trunc('month', c.created_at) ORDER BY c.created_at, c.id) AS rn
  FROM fx_quota_calls c LEFT JOIN fx_quotas q ON c.user_id = q.user_id)
, st AS (
  SELECT DISTINCT user_id, month, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DATE) AS day, 0 AS code, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS m FROM c
  UNION ALL
  SELECT user_id, month, rn, id, day, code, CASE WHEN code = 0 THEN d0 + tok ELSE d0 END, CASE WHEN code = 0 THEN m0 + tok ELSE m0 END FROM (
    SELECT x.*, CASE WHEN tok > greatest(0, qd - d0) THEN 22002 WHEN tok > greatest(0, qm - m0) THEN 22003 ELSE 0 END AS code FROM (
      SELECT c.*, CASE WHEN c.day = st.day THEN st.d ELSE 0 END AS d0, st.m AS m0
      FROM st JOIN c ON c.user_id IS NOT DISTINCT FROM st.user_id AND c.month = st.month AND c.rn = st.rn + 1) x) y)
SELECT id, user_id, code = 0 AS accepted, code FROM st WHERE id IS NOT NULL"""


@job("quota_replay", "fx_quota_calls fx_quotas", QUOTA_REPLAY)
def _(v):
    return quotas.quota_replay(v("fx_quota_calls"), v("fx_quotas")).select("id", "user_id", "accepted", "code")


# The same calls in slices of a day.
@job("quota_replay_large_groups", "fx_quota_calls fx_quotas", QUOTA_REPLAY)
def _(v):
    return quotas.quota_replay(v("fx_quota_calls"), v("fx_quotas"), slice_seconds=DAY).select("id", "user_id", "accepted", "code")


# ---- call log ----

@job("attempt_budget", "fx_ai_calls", """
SELECT task_id, count(*) AS calls, count(*) - 16 AS over_by FROM fx_ai_calls GROUP BY task_id HAVING count(*) > 16""")
def _(v):
    return costs.attempt_budget(v("fx_ai_calls"))


@job("call_cost_cube", "fx_ai_calls", """
, c AS (SELECT *, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM fx_ai_calls)
SELECT user_id, model, day, CAST(GROUPING(user_id, model, day) AS INT) AS level, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_amount) AS DOUBLE) AS cost_amount
FROM c GROUP BY CUBE (user_id, model, day)""")
def _(v):
    return costs.call_cost_cube(v("fx_ai_calls")).withColumn("cost_amount", F.col("cost_amount").cast("double"))


@job("call_latency_stats", "fx_ai_calls", """
SELECT model, round(quantile_cont(latency_ms, 0.5), 3) AS p50, round(quantile_cont(latency_ms, 0.95), 3) AS p95, max(latency_ms) AS max, count(*) AS n,
  avg(CASE WHEN status = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_share FROM fx_ai_calls GROUP BY model""")
def _(v):
    stats = costs.call_latency_stats(v("fx_ai_calls"))
    return stats.withColumn("p50", F.round("p50", 3)).withColumn("p95", F.round("p95", 3))


# The value that occurs at the percentile, without interpolation.
@job("call_latency_stats_approx", "fx_ai_calls", """
SELECT model, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS max, count(*) AS n FROM fx_ai_calls GROUP BY model""")
def _(v):
    return percentiles(v("fx_ai_calls"), ["model"], "latency_ms", exact=False)


@job("failure_streaks", "fx_ai_calls", """
, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at, id) - row_number() OVER (PARTITION BY model, status ORDER BY created_at, id) AS island FROM fx_ai_calls)
SELECT model, count(*) AS length, min(created_at) AS first_at, max(created_at) AS last_at FROM n WHERE status = 2 GROUP BY model, island HAVING count(*) >= 2""")
def _(v):
    return costs.failure_streaks(v("fx_ai_calls"), at_least=2)


@job("task_lineage", "fx_users fx_chunk_sessions fx_tasks fx_ai_calls", """
SELECT u.id AS user_id, u.username, s.upload_id, s.file_name, t.task_id, t.status AS task_status, c.id AS call_id, c.model, c.total_tokens
FROM fx_users u LEFT JOIN fx_chunk_sessions s ON s.user_id = u.id LEFT JOIN fx_tasks t ON t.upload_id = s.upload_id LEFT JOIN fx_ai_calls c ON c.task_id = t.task_id""")
def _(v):
    return costs.task_lineage(v("fx_users"), v("fx_chunk_sessions"), v("fx_tasks"), v("fx_ai_calls"))
