"""Registered jobs: users, requests, error codes."""

from pyspark.sql import functions as F

from harness.registry import job, moment
from mediaops import schemas as s
from mediaops.functions import rules
from mediaops.operators import users


@job("validate_registrations", "fx_registrations", r"""
, j AS (SELECT request_id, CASE WHEN username IS NULL OR NOT (length(username) BETWEEN 2 AND 64 AND regexp_full_match(username, '[a-zA-Z0-9_]+')) THEN 'username'
  WHEN email IS NULL OR NOT (length(email) <= 128 AND regexp_full_match(email, '[^@\s]+@[^@\s]+')) THEN 'email' WHEN NOT length(password) BETWEEN 6 AND 32 THEN 'password' END AS field FROM fx_registrations)
SELECT request_id, CASE WHEN field IS NULL THEN 0 ELSE 10001 END AS code, field FROM j""")
def _(v):
    return rules.judge(v("fx_registrations"), rules.user_rules()).select("request_id", "code", "field")


@job("user_flags", "fx_users", """
SELECT id, coalesce(status = 1, false) AS enabled, coalesce(role = 'ADMIN', false) AS admin, coalesce(role IN ('VIP', 'ADMIN'), false) AS vip FROM fx_users""")
def _(v):
    return users.user_flags(v("fx_users")).select("id", "enabled", "admin", "vip")


@job("mask_secrets", "fx_users", """
SELECT id, user_id, username, email, CASE WHEN length(api_key) >= 12 THEN left(api_key, 8) || '***' || right(api_key, 4) ELSE '***' END AS api_key, role, status, rate_limit FROM fx_users""")
def _(v):
    return users.mask_secrets(v("fx_users"))


@job("role_defaults", "fx_users", """
SELECT id, role, CASE role WHEN 'VIP' THEN 200 WHEN 'ADMIN' THEN 1000 ELSE 100 END AS default_qps,
  CAST(CASE role WHEN 'VIP' THEN 50000 WHEN 'ADMIN' THEN 1000000 ELSE 10000 END AS BIGINT) AS default_quota FROM fx_users""")
def _(v):
    return users.role_defaults(v("fx_users")).select("id", "role", "default_qps", "default_quota")


@job("count_where", "fx_users", """
SELECT count(*) FILTER (WHERE username = 'Customer#000000003' AND status = 1) AS n FROM fx_users""")
def _(v):
    return users.count_where(v("fx_users"), (F.col("username") == "Customer#000000003") & (F.col("status") == 1))


@job("attribute_requests", "fx_requests fx_users", """
SELECT r.req_id, u.id AS auth_user_id, CASE WHEN r.api_key IS NULL THEN 10002 WHEN length(r.api_key) < 10 OR NOT (starts_with(r.api_key, 'sk_live_') OR starts_with(r.api_key, 'sk_test_')) THEN 10001
  WHEN u.id IS NULL THEN 23002 ELSE 0 END AS auth_code
FROM fx_requests r LEFT JOIN fx_users u ON r.api_key = u.api_key AND u.status = 1""")
def _(v):
    return users.attribute_requests(v("fx_requests"), v("fx_users")).select("req_id", "auth_user_id", "auth_code")


ERRORS = ", errors(code, message) AS (VALUES " + ", ".join(f"({c}, '{m}')" for c, m in s.ERROR_CODES) + """)
, e AS (SELECT r.req_id, r.code AS raw_code, coalesce(x.code, 10000) AS code, coalesce(x.message, (SELECT message FROM errors WHERE code = 10000)) AS message
  FROM fx_requests r LEFT JOIN errors x ON r.code = x.code)
, d AS (SELECT *, code // 10000 AS family, CASE WHEN code = 0 THEN 200 WHEN code >= 40000 THEN 429 WHEN code >= 30000 THEN 503 WHEN code = 23005 THEN 401
  WHEN code = 23002 THEN 403 ELSE 400 END AS http_status FROM e)
"""


@job("error_dimension", "fx_requests", ERRORS + "SELECT req_id, raw_code, code, family, message, http_status FROM d")
def _(v):
    return users.error_dimension(v("fx_requests")).select("req_id", "raw_code", "code", "family", "message", "http_status")


@job("error_mix", "fx_requests", ERRORS + "SELECT family, http_status, count(*) AS n FROM d GROUP BY 1, 2")
def _(v):
    return users.error_mix(v("fx_requests"))


@job("user_admin_update", "fx_users", """
SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 500 ELSE rate_limit END AS rate_limit,
  CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM fx_users""")
def _(v):
    changes = v("fx_users").select(
        "id", (F.col("id") % 9 == 0).alias("disable"), F.when(F.col("id") % 4 == 0, 500).alias("rate_limit")
    )
    known = v("fx_users").withColumn("updated_at", moment("2024-01-01 00:00:00"))
    return users.user_admin_update(known, changes, moment("2024-03-01 00:00:00")).select("id", "status", "rate_limit", "updated_at")


@job("register_batch", "fx_registrations fx_users", """
, r AS (SELECT *, row_number() OVER (ORDER BY request_id) AS rn, username IN (SELECT username FROM fx_users) AS name_used, email IN (SELECT email FROM fx_users) AS mail_used FROM fx_registrations)
, st AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, 0 AS code, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails
  UNION ALL
  SELECT rn, request_id, code, CASE WHEN code = 0 THEN list_append(names, username) ELSE names END, CASE WHEN code = 0 THEN list_append(mails, email) ELSE mails END FROM (
    SELECT r.*, st.names, st.mails, CASE WHEN r.username IS NULL OR r.email IS NULL THEN 10001 WHEN r.name_used OR list_contains(st.names, r.username) THEN 23003 WHEN r.mail_used OR list_contains(st.mails, r.email) THEN 23004 ELSE 0 END AS code
    FROM st JOIN r ON r.rn = st.rn + 1) x)
SELECT request_id, code FROM st WHERE request_id IS NOT NULL""")
def _(v):
    return users.register_batch(v("fx_registrations"), v("fx_users")).select("request_id", "code")
