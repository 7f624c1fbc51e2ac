"""Registered jobs: whole flows."""

from pyspark.sql import functions as F

from harness.catalog.results import ScriptedClient
from harness.catalog.uploads import ACKS, CHUNKS, FIRST_MERGED
from harness.fixtures import BUCKET
from harness.registry import job, moment
from mediaops.plans import task_flow, upload_flow


@job("flow_upload_init", "fx_upload_requests fx_uploads", FIRST_MERGED + r"""
, judged AS (SELECT *, CASE
  WHEN NOT regexp_matches(file_name, '\S') OR length(file_name) > 255 OR file_size < 1 OR file_size > 5368709120
    OR coalesce(NOT regexp_full_match(file_hash, '[a-fA-F0-9]{32,64}'), false) OR coalesce(chunk_size < 1048576 OR chunk_size > 52428800, false) OR length(prompt) > 2000 THEN 10001
  WHEN list_last(string_split(lower(file_name), '.')) NOT IN ('mp4','avi','mov','mkv','wmv','flv') THEN 20005 ELSE 0 END AS code FROM fx_upload_requests)
, m AS (SELECT j.request_id, j.user_id, j.code, j.file_size, coalesce(j.chunk_size, 5242880) AS chunk, j.created_at, r.upload_id AS matched, r.chunk_size AS old_chunk, r.total_chunks AS old_total, r.uploaded_chunks AS old_chunks,
    CASE WHEN j.code <> 0 THEN NULL WHEN r.upload_id IS NOT NULL AND r.status = 2 THEN 'INSTANT' WHEN r.upload_id IS NOT NULL THEN 'RESUME' ELSE 'NEW' END AS decision
  FROM judged j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY status DESC) AS pick FROM ranked WHERE rn = 1 AND status IN (0, 2)) r
  ON j.file_hash = r.file_hash AND r.pick = 1 AND j.code = 0)
SELECT request_id, user_id, code, decision, matched AS matched_upload_id, CASE WHEN decision = 'NEW' THEN chunk WHEN decision = 'RESUME' THEN old_chunk END AS chunk_size,
  CASE WHEN decision = 'NEW' THEN CAST((file_size + chunk - 1) // chunk AS INT) WHEN decision = 'RESUME' THEN old_total END AS total_chunks,
  CASE WHEN decision = 'RESUME' THEN array_to_string(CAST(old_chunks AS INT[]), ',') END AS uploaded_chunks,
  CASE WHEN decision = 'NEW' THEN created_at + INTERVAL 24 HOUR END AS expired_at FROM m""")
def _(v):
    return upload_flow.init_uploads(v("fx_upload_requests"), v("fx_uploads"), resume=True).drop(
        "field", "last_chunk_bytes"
    ).withColumn("uploaded_chunks", F.array_join("uploaded_chunks", ","))


@job("flow_upload_complete", ACKS, CHUNKS + """
SELECT upload_id, status, CASE WHEN expired_at < TIMESTAMP '1997-06-01' THEN 20002 WHEN status <> 0 THEN 20001 WHEN len(idx) <> total_chunks THEN 20004 ELSE 0 END AS code,
  CASE WHEN coalesce(expired_at >= TIMESTAMP '1997-06-01', true) AND status = 0 AND len(idx) = total_chunks THEN CASE WHEN total_chunks > 0 THEN 2 ELSE 1 END ELSE status END AS new_status,
  CASE WHEN coalesce(expired_at >= TIMESTAMP '1997-06-01', true) AND status = 0 AND len(idx) = total_chunks AND total_chunks > 0
    THEN 'videos/1997/06/01/' || upload_id || CASE WHEN id % 2 = 0 THEN '.mp4' ELSE '.mov' END END AS storage_path,
  CASE WHEN coalesce(expired_at >= TIMESTAMP '1997-06-01', true) AND status = 0 AND len(idx) = total_chunks THEN TIMESTAMP '1997-06-01' END AS updated_at FROM chunks""")
def _(v):
    return upload_flow.complete_uploads(
        v("fx_chunk_sessions"), v("fx_chunk_acks"), moment("1997-06-01 00:00:00")
    )


# Tasks that have a message and may start; the number in the url scripts the outcome.
@job("flow_worker", "fx_tasks fx_task_events", """
, t AS (SELECT t.*, t.task_id IN (SELECT task_id FROM fx_task_events) AND coalesce(t.status, '') IN ('PENDING', 'QUEUED', 'RETRYING') AS taken FROM fx_tasks t)
, r AS (SELECT *, taken AND id % 7 NOT IN (0, 2, 3) AS ok, taken AND id % 7 IN (0, 2, 3) AS bad, coalesce(retry_count < max_retry, false) AS can FROM t)
SELECT task_id, CASE WHEN ok THEN 'COMPLETED' WHEN bad AND can THEN 'RETRYING' WHEN bad THEN 'DEAD' ELSE status END AS status,
  CASE WHEN ok THEN 100 WHEN bad THEN 20 ELSE progress END AS progress, CASE WHEN bad AND can THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN ok THEN 'COMPLETED' WHEN bad AND can THEN 'RETRYING' WHEN bad THEN 'DEAD' END AS event, CASE WHEN bad AND can THEN retry_count + 1 END AS message_retry,
  bad AND NOT can AS is_dead_letter FROM r""")
def _(v):
    out = task_flow.run_worker(
        v("fx_task_events").select("task_id", "retry_count"),
        v("fx_tasks").withColumn("result", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
        .withColumn("frame_count", F.lit(None).cast("int")),
        ScriptedClient(), BUCKET, moment("2024-02-01 00:00:00"), delays=(0, 0, 0), parallelism=v.cores,
    )
    return (
        out.tasks.select("task_id", "status", "progress", "retry_count")
        .join(out.events.select("task_id", "event"), "task_id", "left")
        .join(out.retries.select("task_id", F.col("retry_count").alias("message_retry")), "task_id", "left")
        .join(out.dead_letters.select("task_id", F.lit(True).alias("_dead")), "task_id", "left")
        .withColumn("is_dead_letter", F.coalesce("_dead", F.lit(False))).drop("_dead")
    )
