"""Registered jobs: sources and sinks, through files in the shared folder."""

import os

from pyspark.sql import functions as F

from harness.catalog.tasks import MESSAGES, _outbound
from harness.fixtures import BUCKET
from harness.registry import job
from mediaops import schemas as s
from mediaops.operators import tasks
from mediaops.session import scratch
from mediaops.sources import objects, tables, topics


@job("src_tables", "fx_users fx_uploads fx_tasks fx_quotas fx_ai_calls", """
SELECT 'user' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(status) AS BIGINT) AS check_sum FROM fx_users
UNION ALL SELECT 'upload_session', count(*), CAST(sum(id) AS BIGINT), CAST(sum(total_size) AS BIGINT) FROM fx_uploads
UNION ALL SELECT 'analysis_task', count(*), CAST(sum(id) AS BIGINT), CAST(sum(progress) AS BIGINT) FROM fx_tasks
UNION ALL SELECT 'user_quota', count(*), CAST(sum(id) AS BIGINT), CAST(sum(quota_monthly) AS BIGINT) FROM fx_quotas
UNION ALL SELECT 'ai_call_log', count(*), CAST(sum(id) AS BIGINT), CAST(sum(cost_amount) * 1000000 AS BIGINT) FROM fx_ai_calls""")
def _(v):
    made = {
        "user": "fx_users", "upload_session": "fx_uploads", "analysis_task": "fx_tasks",
        "user_quota": "fx_quotas", "ai_call_log": "fx_ai_calls",
    }
    root = scratch(v.spark, "tables")
    for name, view in made.items():
        tables.conform(v(view), s.TABLES[name]).write.parquet(f"{root}/{name}")
    loaded = tables.load_tables(v.spark, root)
    check = {
        "user": F.sum("status"), "upload_session": F.sum("total_size"), "analysis_task": F.sum("progress"),
        "user_quota": F.sum("quota_monthly"), "ai_call_log": F.sum("cost_amount") * 1_000_000,
    }
    parts = [
        loaded[name].agg(F.count("*").alias("n"), F.sum("id").alias("ids"), check[name].cast("long").alias("check_sum"))
        .select(F.lit(name).alias("name"), "n", "ids", "check_sum")
        for name in made
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read_messages(v):
    path = scratch(v.spark, "messages")
    topics.publish_task_messages(_outbound(v), {"format": "text", "path": path})
    return path


@job("snk_task_messages", "fx_tasks", MESSAGES)
def _(v):
    read = topics.read_task_messages(v.spark, {"format": "text", "path": _read_messages(v)}, streaming=False)
    return read.drop("video_duration", "corrupt").withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


# Every third record is cut short before it is read.
@job("src_task_messages", "fx_tasks", """
SELECT CASE WHEN id % 3 > 0 THEN task_id END AS task_id, CASE WHEN id % 3 > 0 THEN user_id END AS user_id, CASE WHEN id % 3 > 0 THEN created_at END AS sent_at,
  id % 3 = 0 AS is_corrupt FROM fx_tasks""")
def _(v):
    sent = v("fx_tasks").withColumn("sent_at", F.col("created_at"))
    whole = topics.as_records(sent, s.TASK_MESSAGE)
    broken = F.regexp_extract("key", r"(\d+)$", 1).cast("long") % 3 == 0
    path = scratch(v.spark, "topic")
    whole.select(
        F.when(broken, F.expr("substring(value, 1, length(value) - 2)")).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    read = topics.read_task_messages(v.spark, {"format": "text", "path": path}, streaming=False)
    bad = F.col("corrupt").isNotNull()
    return read.select(
        F.when(~bad, F.col("task_id")).alias("task_id"), F.when(~bad, F.col("user_id")).alias("user_id"),
        F.when(~bad, F.col("sent_at").cast("timestamp_ntz")).alias("sent_at"), bad.alias("is_corrupt"),
    )


def _events(v):
    kinds = F.when(F.col("status") == "COMPLETED", topics.COMPLETED).when(
        F.col("status") == "RETRYING", topics.RETRYING
    ).when(F.col("status") == "FAILED", topics.DEAD).otherwise(F.col("status"))
    return v("fx_task_events").select(
        "task_id", kinds.alias("event"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("d"), F.col("seq"))).alias("detail"),
        F.col("ts").alias("sent_at"),
    )


EVENTS = """
SELECT task_id, CASE status WHEN 'FAILED' THEN 'DEAD' ELSE status END AS event, CASE WHEN seq % 2 = 0 THEN 'd' || CAST(seq AS VARCHAR) ELSE '' END AS detail,
  date_trunc('milliseconds', ts) AS sent_at FROM fx_task_events WHERE status IN ('COMPLETED', 'RETRYING', 'FAILED')"""


@job("snk_task_events", "fx_task_events", EVENTS)
def _(v):
    path = scratch(v.spark, "events")
    topics.publish_task_events(_events(v), {"format": "text", "path": path})
    read = topics.read_task_events(v.spark, {"format": "text", "path": path}, streaming=False)
    return read.drop("corrupt").withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


@job("src_task_events", "fx_task_events", f"SELECT event, count(*) AS n, min(sent_at) AS first_at, count(*) FILTER (WHERE detail = '') AS no_detail FROM ({EVENTS}) GROUP BY event")
def _(v):
    path = scratch(v.spark, "events")
    topics.publish_task_events(_events(v), {"format": "text", "path": path})
    read = topics.read_task_events(v.spark, {"format": "text", "path": path}, streaming=False)
    return read.groupBy("event").agg(
        F.count("*").alias("n"), F.min("sent_at").cast("timestamp_ntz").alias("first_at"),
        F.count(F.when(F.col("detail") == "", 1)).alias("no_detail"),
    )


@job("src_dead_letters", "fx_tasks", """
SELECT task_id, coalesce(left(error_message, 500), '') AS error, retry_count, created_at AS sent_at FROM fx_tasks
WHERE status = 'FAILED' AND coalesce(retry_count >= max_retry, true)""")
def _(v):
    failed = v("fx_tasks").filter("status = 'FAILED'")
    _, dead = tasks.route_failures(failed, F.col("created_at"))
    path = scratch(v.spark, "dead")
    topics.publish_dead_letters(dead, {"format": "text", "path": path})
    read = topics.read_dead_letters(v.spark, {"format": "text", "path": path}, streaming=False)
    return read.drop("corrupt").withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


@job("snk_videos_by_date", "fx_uploads", """
SELECT strftime(created_at, '%Y') AS year, strftime(created_at, '%m') AS month, strftime(created_at, '%d') AS day, count(*) AS n, CAST(sum(total_size) AS BIGINT) AS bytes
FROM fx_uploads GROUP BY 1, 2, 3""")
def _(v):
    path = scratch(v.spark, "by-date")
    tables.write_by_date(v("fx_uploads"), path, "created_at")
    back = v.spark.read.option("basePath", path).schema(
        "total_size long, year string, month string, day string"
    ).parquet(path)
    return back.groupBy("year", "month", "day").agg(F.count("*").alias("n"), F.sum("total_size").alias("bytes"))


def _stage(v):
    """Writes every document as an object under the path its upload has."""
    root = scratch(v.spark, "objects")
    rows = v("fx_uploads").select("id", "storage_path", "status", "upload_id").join(
        v("documents").select(F.col("doc_id").alias("id"), "text"), "id"
    ).select(
        F.when((F.col("status") == 2) & (F.col("id") % 4 != 0), F.col("storage_path")).otherwise(
            F.concat(F.lit("chunks/"), F.col("upload_id"), F.lit("/chunk_"), (F.col("id") % 3).cast("string"))
        ).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )

    def put(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                store.create_dir(os.path.dirname(f"{base}/{path}"))
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows.repartition(v.cores).mapInPandas(put, "n long").agg(F.sum("n")).first()
    return root


STAGED = """
, staged AS (SELECT u.id, u.upload_id, CASE WHEN u.status = 2 AND u.id % 4 <> 0 THEN u.storage_path ELSE 'chunks/' || u.upload_id || '/chunk_' || CAST(u.id % 3 AS VARCHAR) END AS path,
  octet_length(encode(d.text)) AS length, d.text FROM fx_uploads u JOIN documents d ON u.id = d.doc_id)
"""


@job("src_object_listing", "fx_uploads", STAGED + """
SELECT path, CAST(length AS BIGINT) AS length, CASE WHEN starts_with(path, 'chunks') THEN 'chunk' ELSE 'video' END AS kind,
  CASE WHEN starts_with(path, 'chunks') THEN upload_id ELSE 'upload_' || CAST(id AS VARCHAR) END AS upload_id,
  CASE WHEN starts_with(path, 'chunks') THEN CAST(id % 3 AS INT) END AS chunk_index,
  CASE WHEN NOT starts_with(path, 'chunks') THEN replace(substr(path, 8, 10), '/', '-') END AS day FROM staged""")
def _(v):
    listed = objects.listing_table(v.spark, _stage(v), BUCKET)
    return listed.select("path", "length", "kind", "upload_id", "chunk_index", "day")


# Few documents exceed two samples of 2 KiB, so all three shapes of the sample occur. The last 8 bytes are the size
# as a little-endian double: exponent and fraction are put together as an integer.
@job("content_fingerprint", "fx_uploads", STAGED + """
, sized AS (SELECT path, CAST(length AS BIGINT) AS length, hex(encode(text)) AS h, least(2048, length) AS take, length(bin(length)) - 1 AS e FROM staged)
, sampled AS (SELECT path, length,
    substr(h, 1, 2 * take) || CASE WHEN length > 2 * take THEN substr(h, (length - take) // 2 * 2 + 1, 2 * take) ELSE '' END ||
      CASE WHEN length > take THEN substr(h, 2 * (length - take) + 1, 2 * take) ELSE '' END AS parts,
    CASE WHEN length = 0 THEN repeat('0', 16) ELSE printf('%016x', (1023 + e)::BIGINT * 4503599627370496 + (length - (1::BIGINT << e)) * (1::BIGINT << (52 - e))) END AS x
  FROM sized)
SELECT path, length, sha256(unhex(parts || substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2)
  || substr(x, 3, 2) || substr(x, 1, 2))) AS fingerprint FROM sampled""")
def _(v):
    listed = objects.listing_table(v.spark, _stage(v), BUCKET)
    return objects.content_fingerprint(listed, sample=2048, parallelism=v.cores)


@job("content_digest", "", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _(v):
    return v("documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
