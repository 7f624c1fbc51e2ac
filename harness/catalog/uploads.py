"""Registered jobs: upload sessions, chunks, repeated content."""

from pyspark.sql import functions as F

from harness.fixtures import BUCKET
from harness.registry import job, moment
from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.functions import rules
from mediaops.operators import uploads

# Sorted distinct in-range chunks per session, used by several oracles.
CHUNKS = """
, chunks AS (
  SELECT s.*, coalesce(c.idx, []) AS idx FROM fx_chunk_sessions s LEFT JOIN (
    SELECT a.upload_id, list_sort(list(DISTINCT a.chunk_index)) AS idx
    FROM fx_chunk_acks a JOIN fx_chunk_sessions t ON a.upload_id = t.upload_id
    WHERE a.chunk_index >= 0 AND a.chunk_index < t.total_chunks GROUP BY a.upload_id) c ON s.upload_id = c.upload_id)
"""
ACKS = "fx_chunk_acks fx_chunk_sessions"


@job("upload_progress", ACKS, CHUNKS + """
SELECT upload_id, total_chunks, array_to_string(idx, ',') AS chunks, CAST(len(idx) AS INT) AS done,
  CASE WHEN total_chunks > 0 THEN CAST(floor(len(idx) * 100.0 / total_chunks) AS INT) ELSE 0 END AS progress,
  CASE status WHEN 0 THEN 'UPLOADING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'MERGED' WHEN 3 THEN 'EXPIRED' ELSE 'MERGE_FAILED' END AS status_name
FROM chunks""")
def _(v):
    return uploads.upload_progress(v("fx_chunk_acks"), v("fx_chunk_sessions")).withColumn(
        "chunks", F.array_join("chunks", ",")
    )


@job("upload_completeness", ACKS, CHUNKS + """
SELECT upload_id, total_chunks, CAST(total_chunks - len(idx) AS INT) AS missing, total_chunks = len(idx) AS complete,
  CASE WHEN total_chunks = len(idx) THEN 0 ELSE 20004 END AS code FROM chunks""")
def _(v):
    return uploads.upload_completeness(v("fx_chunk_acks"), v("fx_chunk_sessions"))


@job("missing_chunks", ACKS, """
SELECT s.upload_id, CAST(g.i AS INT) AS chunk_index FROM fx_chunk_sessions s, generate_series(0, 9) AS g(i)
WHERE g.i < s.total_chunks AND NOT EXISTS (
  SELECT 1 FROM fx_chunk_acks a WHERE a.upload_id = s.upload_id AND a.chunk_index = g.i)""")
def _(v):
    return uploads.missing_chunks(v("fx_chunk_acks"), v("fx_chunk_sessions"))


@job("compose_manifest", ACKS, CHUNKS + """
, paths AS (
  SELECT c.upload_id, string_agg('chunks/' || c.upload_id || '/chunk_' || CAST(g.i AS VARCHAR), ',' ORDER BY g.i) AS chunk_paths
  FROM chunks c, generate_series(0, 9) AS g(i) WHERE g.i < c.total_chunks GROUP BY c.upload_id)
SELECT c.upload_id, p.chunk_paths, 'videos/' || strftime(c.created_at, '%Y/%m/%d') || '/' || c.upload_id || '.' ||
  lower(string_split(c.file_name, '.')[2]) AS target_path
FROM chunks c JOIN paths p ON c.upload_id = p.upload_id WHERE len(c.idx) = c.total_chunks""")
def _(v):
    return uploads.compose_manifest(
        v("fx_chunk_acks"), v("fx_chunk_sessions"), F.col("created_at")
    ).withColumn("chunk_paths", F.array_join("chunk_paths", ","))


@job("check_chunk_bounds", ACKS, """
SELECT a.upload_id, a.chunk_index, s.total_chunks,
  CASE WHEN s.upload_id IS NULL THEN 20001 WHEN a.chunk_index < 0 OR a.chunk_index >= s.total_chunks THEN 20003 ELSE 0 END AS code
FROM fx_chunk_acks a LEFT JOIN fx_chunk_sessions s ON a.upload_id = s.upload_id""")
def _(v):
    return uploads.check_chunk_bounds(v("fx_chunk_acks"), v("fx_chunk_sessions")).drop("acked_at")


@job("chunk_set_ops", "fx_uploads", """
, p AS (SELECT upload_id, CAST(id % 6 AS INT) AS i, CAST(uploaded_chunks AS INT[]) AS c, status <> 0 AS shut FROM fx_uploads)
SELECT upload_id, i AS chunk_index, list_contains(c, i) AS already,
  array_to_string(CASE WHEN shut OR list_contains(c, i) THEN c ELSE list_append(c, i) END, ',') AS chunks_after,
  CAST(len(c) + CASE WHEN shut OR list_contains(c, i) THEN 0 ELSE 1 END AS INT) AS count_after,
  CASE WHEN NOT shut AND NOT list_contains(c, i) THEN TIMESTAMP '2024-01-15 10:00:00' END AS updated_at FROM p""")
def _(v):
    indexed = v("fx_uploads").withColumn("chunk_index", (F.col("id") % 6).cast("int"))
    return uploads.chunk_set_ops(indexed, moment("2024-01-15 10:00:00")).select(
        "upload_id", "chunk_index", "already",
        F.array_join("chunks_after", ",").alias("chunks_after"), "count_after", "updated_at",
    )


@job("validate_upload_requests", "fx_upload_requests", r"""
, judged AS (SELECT request_id, CASE
  WHEN file_name IS NULL OR NOT regexp_matches(file_name, '\S') OR length(file_name) > 255 THEN '10001 file_name'
  WHEN file_size IS NULL OR file_size < 1 OR file_size > 5368709120 THEN '10001 file_size'
  WHEN NOT regexp_full_match(file_hash, '[a-fA-F0-9]{32,64}') THEN '10001 file_hash'
  WHEN chunk_size < 1048576 OR chunk_size > 52428800 THEN '10001 chunk_size'
  WHEN length(prompt) > 2000 THEN '10001 prompt'
  WHEN length(metadata) > 4096 THEN '10001 metadata'
  WHEN list_last(string_split(lower(file_name), '.')) NOT IN ('mp4','avi','mov','mkv','wmv','flv') THEN '20005 file_name'
  WHEN file_size > 3000000 THEN '20006 file_size' END AS r FROM fx_upload_requests)
SELECT request_id, CAST(coalesce(string_split(r, ' ')[1], '0') AS INT) AS code, string_split(r, ' ')[2] AS field FROM judged""")
def _(v):
    judged = rules.judge(v("fx_upload_requests"), rules.upload_rules(max_file_size=3_000_000))
    return judged.select("request_id", "code", "field")


@job("valid_sessions", "fx_upload_requests fx_uploads", """
SELECT r.request_id, r.upload_id, s.expired_at,
  CASE WHEN s.upload_id IS NULL THEN 20001 WHEN s.expired_at < TIMESTAMP '2024-01-02 08:00:00' THEN 20002 ELSE 0 END AS code
FROM (SELECT request_id, 'upload_' || CAST(request_id * 40 AS VARCHAR) || '_abc123' AS upload_id FROM fx_upload_requests) r
LEFT JOIN fx_uploads s ON r.upload_id = s.upload_id""")
def _(v):
    keys = v("fx_upload_requests").select(
        "request_id",
        F.concat(F.lit("upload_"), (F.col("request_id") * 40).cast("string"), F.lit("_abc123")).alias("upload_id"),
    )
    return uploads.valid_sessions(keys, v("fx_uploads"), moment("2024-01-02 08:00:00"))


FIRST_MERGED = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY file_hash, status ORDER BY created_at, upload_id) AS rn FROM fx_uploads)
"""


@job("first_merged_per_hash", "fx_uploads", FIRST_MERGED + """
SELECT file_hash, upload_id, user_id, total_size, storage_path, created_at FROM ranked WHERE rn = 1 AND status = 2""")
def _(v):
    return uploads.first_merged_per_hash(v("fx_uploads")).select(
        "file_hash", "upload_id", "user_id", "total_size", "storage_path", "created_at"
    )


@job("instant_upload_match", "fx_uploads fx_upload_requests", FIRST_MERGED + """
SELECT r.request_id, r.user_id, CASE WHEN m.upload_id IS NOT NULL THEN 'INSTANT' ELSE 'NEW' END AS decision,
  m.upload_id AS matched_upload_id, m.user_id AS owner_id
FROM fx_upload_requests r LEFT JOIN ranked m ON r.file_hash = m.file_hash AND m.rn = 1 AND m.status = 2""")
def _(v):
    return uploads.match_uploads(v("fx_upload_requests"), v("fx_uploads")).select(
        "request_id", "user_id", "decision", "matched_upload_id", "owner_id"
    )


@job("resume_match", "fx_uploads fx_upload_requests", FIRST_MERGED + """
SELECT r.request_id, r.user_id, CASE WHEN m.upload_id IS NOT NULL THEN 'INSTANT' WHEN o.upload_id IS NOT NULL THEN 'RESUME' ELSE 'NEW' END AS decision,
  coalesce(m.upload_id, o.upload_id) AS matched_upload_id, coalesce(m.user_id, o.user_id) AS owner_id,
  CASE WHEN m.upload_id IS NULL THEN o.chunk_size END AS resume_chunk_size, CASE WHEN m.upload_id IS NULL THEN o.total_chunks END AS resume_total_chunks,
  CASE WHEN m.upload_id IS NULL THEN array_to_string(CAST(o.uploaded_chunks AS INT[]), ',') END AS resume_chunks
FROM fx_upload_requests r LEFT JOIN ranked m ON r.file_hash = m.file_hash AND m.rn = 1 AND m.status = 2
LEFT JOIN ranked o ON r.file_hash = o.file_hash AND o.rn = 1 AND o.status = 0""")
def _(v):
    return uploads.match_uploads(v("fx_upload_requests"), v("fx_uploads"), resume=True).select(
        "request_id", "user_id", "decision", "matched_upload_id", "owner_id", "resume_chunk_size", "resume_total_chunks",
        F.array_join("resume_chunks", ",").alias("resume_chunks"),
    )


@job("chunk_plan", "fx_upload_requests", """
SELECT request_id, coalesce(chunk_size, 5242880) AS chunk_size,
  CAST(ceil(file_size / CAST(coalesce(chunk_size, 5242880) AS DOUBLE)) AS INT) AS total_chunks,
  file_size - (CAST(ceil(file_size / CAST(coalesce(chunk_size, 5242880) AS DOUBLE)) AS BIGINT) - 1) * coalesce(chunk_size, 5242880) AS last_chunk_bytes,
  created_at + INTERVAL 1 DAY AS expired_at FROM fx_upload_requests""")
def _(v):
    return uploads.chunk_plan(v("fx_upload_requests")).select(
        "request_id", "chunk_size", "total_chunks", "last_chunk_bytes", "expired_at"
    )


@job("dedup_savings", "fx_uploads", """
SELECT file_hash, count(*) AS copies, CAST(sum(total_size) AS BIGINT) AS bytes,
  CAST(sum(total_size) - max(total_size) AS BIGINT) AS bytes_saved FROM fx_uploads GROUP BY file_hash""")
def _(v):
    return uploads.dedup_savings(v("fx_uploads"))


@job("daily_ingest_volume", "fx_uploads", """
SELECT replace(substr(storage_path, 8, 10), '/', '-') AS day, count(*) AS files, CAST(sum(total_size) AS BIGINT) AS bytes
FROM fx_uploads WHERE storage_path IS NOT NULL GROUP BY 1""")
def _(v):
    return uploads.daily_ingest_volume(v("fx_uploads"))


@job("daily_stats", "fx_uploads fx_tasks", """
SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS day, stat, count(*) AS n FROM (
  SELECT created_at AS t, 'uploads' AS stat FROM fx_uploads UNION ALL
  SELECT completed_at, 'tasks_processed' FROM fx_tasks WHERE completed_at IS NOT NULL) GROUP BY 1, 2""")
def _(v):
    return uploads.daily_stats(
        uploads=(v("fx_uploads"), "created_at"), tasks_processed=(v("fx_tasks"), "completed_at")
    )


@job("id_created_at", "fx_uploads", """
SELECT upload_id, TIMESTAMP '2023-12-31 16:00:00' + INTERVAL 1 SECOND * CAST(string_split(upload_id, '_')[2] AS BIGINT) AS id_created_at
FROM fx_uploads""")
def _(v):
    return v("fx_uploads").select(
        "upload_id", fn.id_created_at(F.col("upload_id")).cast("timestamp_ntz").alias("id_created_at")
    )


@job("size_labels", "fx_uploads", """
, sized AS (SELECT upload_id, total_size * CAST([0, 1, 700, 90000, 30000000][1 + id % 5] AS BIGINT) AS size FROM fx_uploads)
SELECT upload_id, size, CASE WHEN size = 0 THEN '0 B'
  WHEN size < 1024 THEN printf('%.1f B', CAST(size AS DOUBLE))
  WHEN size < 1048576 THEN printf('%.1f KB', round(size * 10 / 1024.0::DOUBLE) / 10)
  WHEN size < 1073741824 THEN printf('%.1f MB', round(size * 10 / 1048576.0::DOUBLE) / 10)
  ELSE printf('%.1f GB', round(size * 10 / 1073741824.0::DOUBLE) / 10) END AS label FROM sized""")
def _(v):
    factor = F.element_at(
        F.array(*[F.lit(x).cast("long") for x in (0, 1, 700, 90000, 30000000)]), (1 + F.col("id") % 5).cast("int")
    )
    sized = v("fx_uploads").select("upload_id", (F.col("total_size") * factor).alias("size"))
    return sized.withColumn("label", fn.size_label(F.col("size")))


@job("expire_sessions", "fx_uploads", """
SELECT upload_id, CASE WHEN status = 0 AND expired_at < TIMESTAMP '2024-01-02 06:00:00' THEN 3 ELSE status END AS status,
  CASE WHEN status = 0 AND expired_at < TIMESTAMP '2024-01-02 06:00:00' THEN TIMESTAMP '2024-01-02 06:00:00' ELSE created_at END AS updated_at FROM fx_uploads""")
def _(v):
    sessions = v("fx_uploads").withColumn("updated_at", F.col("created_at"))
    return uploads.expire_sessions(sessions, moment("2024-01-02 06:00:00")).select("upload_id", "status", "updated_at")


@job("session_status_update", ACKS, CHUNKS + """
, m AS (SELECT upload_id, 'videos/' || upload_id AS merged_path, id % 7 = 0 AS failed FROM fx_chunk_sessions WHERE id % 3 <> 0)
, j AS (SELECT c.*, m.merged_path, CASE WHEN c.expired_at < TIMESTAMP '1998-01-01' THEN 20002 WHEN c.status <> 0 THEN 20001
    WHEN len(c.idx) <> c.total_chunks THEN 20004 WHEN m.failed THEN 20009 ELSE 0 END AS code
  FROM chunks c LEFT JOIN m ON c.upload_id = m.upload_id)
SELECT upload_id, status, code, CASE WHEN code = 20009 THEN 4 WHEN code = 0 AND merged_path IS NOT NULL THEN 2 WHEN code = 0 THEN 1 ELSE status END AS new_status,
  CASE WHEN code = 0 THEN coalesce(merged_path, storage_path) ELSE storage_path END AS storage_path,
  CASE WHEN code IN (0, 20009) THEN TIMESTAMP '1998-01-01' END AS updated_at FROM j""")
def _(v):
    sessions = v("fx_chunk_sessions")
    merges = sessions.filter("id % 3 <> 0").select(
        "upload_id", F.expr("'videos/' || upload_id").alias("merged_path"), F.expr("id % 7 = 0").alias("failed")
    )
    return uploads.session_status_update(sessions, v("fx_chunk_acks"), merges, moment("1998-01-01 00:00:00"))


@job("object_path", "fx_objects", """
SELECT path, CASE WHEN starts_with(path, '/media/') THEN substr(path, 8) WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END AS object_path
FROM fx_objects""")
def _(v):
    return v("fx_objects").select("path", fn.object_path(F.col("path"), BUCKET).alias("object_path"))


@job("orphan_chunks", "fx_objects", """
, o AS (SELECT *, regexp_extract(path, 'chunks/([^/]+)/chunk_([0-9]+)$', 1) AS upload_id, regexp_extract(path, 'chunks/([^/]+)/chunk_([0-9]+)$', 2) AS i FROM fx_objects)
SELECT o.path, o.upload_id, CAST(o.i AS INT) AS chunk_index, o.length FROM o
WHERE o.upload_id <> '' AND o.upload_id IN (SELECT upload_id FROM fx_uploads WHERE status IN (2, 3))""")
def _(v):
    parsed = uploads.parse_objects(v("fx_objects"), BUCKET)
    return uploads.orphan_chunks(parsed, v("fx_uploads")).select("path", "upload_id", "chunk_index", "length")


SUBMITS = """
, r AS (SELECT request_id, user_id, prompt, 'upload_' || CAST(request_id * 60 AS VARCHAR) || '_abc123' AS upload_id FROM fx_upload_requests)
"""


@job("submit_tasks", "fx_upload_requests fx_uploads", SUBMITS + """
SELECT 'task_' || CAST(r.request_id AS VARCHAR) AS task_id, r.upload_id, u.user_id, r.user_id AS requested_by, u.storage_path AS video_url,
  CASE WHEN u.upload_id IS NULL THEN NULL ELSE 'PENDING' END AS status, CASE WHEN u.upload_id IS NULL THEN 20001 ELSE 0 END AS code
FROM r LEFT JOIN fx_uploads u ON r.upload_id = u.upload_id AND u.storage_path <> ''""")
def _(v):
    requests = v("fx_upload_requests").withColumn(
        "upload_id", F.concat(F.lit("upload_"), (F.col("request_id") * 60).cast("string"), F.lit("_abc123"))
    )
    tasks, rejects = uploads.submit_tasks(requests, v("fx_uploads"), moment("2024-03-01 00:00:00"))
    made = tasks.select(
        "task_id", "upload_id", "user_id", "requested_by", "video_url", "status", F.lit(s.OK).alias("code")
    )
    refused = rejects.select(
        F.concat(F.lit("task_"), F.col("request_id").cast("string")).alias("task_id"), "upload_id",
        F.lit(None).cast("long").alias("user_id"), F.col("user_id").alias("requested_by"),
        F.lit(None).cast("string").alias("video_url"), F.lit(None).cast("string").alias("status"), "code",
    )
    return made.unionByName(refused)
