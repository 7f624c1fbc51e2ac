"""Stream jobs. Each takes and returns a streaming frame; the writers start a query.

Production reads topics; the same frames come from files in tests. Times are cast to a zoned
timestamp first, because watermarks need one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediaops.functions import columns as fn
from mediaops.operators import tasks
from mediaops.sources import topics

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def use_rocksdb(stream: DataFrame) -> DataFrame:
    """Keeps the state of the session's streams in RocksDB, outside the JVM heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream


def _started(stream: DataFrame, writer, available_now: bool, idle_batches: bool) -> StreamingQuery:
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    conf.set(setting, str(before == "true" and idle_batches).lower())
    try:  # the query keeps the settings it was started with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(setting, before)


def start(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False, idle_batches: bool = True
) -> StreamingQuery:
    """Starts a stream into a Parquet folder, with its state in RocksDB."""
    writer = (
        use_rocksdb(stream).writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return _started(stream, writer, available_now, idle_batches)


def start_batches(
    stream: DataFrame, handle, checkpoint: str, mode: str = "append", available_now: bool = False, idle_batches: bool = True
) -> StreamingQuery:
    """Starts a stream whose batches go through ``handle(frame, batch_id)``."""
    writer = (
        use_rocksdb(stream).writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    )
    return _started(stream, writer, available_now, idle_batches)


def dedup_messages(messages: DataFrame, ts: str = "sent_at", delay: str = "1 hour") -> DataFrame:
    """At-least-once intake made idempotent on (task_id, retry_count). The delay bounds both how
    late a repeat may come and how long a key stays in state."""
    return with_event_time(messages, ts, delay).dropDuplicatesWithinWatermark(
        ["task_id", "retry_count"]
    )


def event_counts(
    events: DataFrame, kind: str = "event", ts: str = "sent_at", every: str = "1 minute",
    delay: str = "10 minutes",
) -> DataFrame:
    """Events per type and window; rows later than the delay are dropped."""
    return (
        with_event_time(events, ts, delay)
        .groupBy(F.window(ts, every), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n")
    )


def rate_sliding(
    requests: DataFrame, key: str = "user_id", ts: str = "ts", size: str = "1 minute",
    slide: str = "10 seconds", delay: str = "1 minute",
) -> DataFrame:
    """Requests per key in hopping windows."""
    return (
        with_event_time(requests, ts, delay)
        .groupBy(F.window(ts, size, slide), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n")
    )


def queue_latency(
    messages: DataFrame, starts: DataFrame, bound: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Milliseconds from sending a message to the start of that attempt.

    ``messages(task_id, attempt, sent_at)``, ``starts(task_id, attempt, started_at)``. A message
    with no start within the bound comes out with null once the watermark proves it.
    """
    sent = with_event_time(messages, "sent_at", delay).alias("m")
    began = with_event_time(starts, "started_at", delay).alias("s")
    return sent.join(
        began,
        F.expr(
            "m.task_id = s.task_id AND m.attempt = s.attempt AND s.started_at >= m.sent_at "
            f"AND s.started_at <= m.sent_at + INTERVAL {bound}"
        ),
        "left_outer",
    ).select(
        "m.task_id", "m.attempt", "m.sent_at", "s.started_at",
        (F.unix_millis("s.started_at") - F.unix_millis("m.sent_at")).alias("latency_ms"),
    )


def upload_bursts(
    acks: DataFrame, ts: str = "acked_at", gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Bursts of chunk activity per upload; a pause longer than the gap ends one."""
    return (
        with_event_time(acks, ts, delay)
        .groupBy(F.session_window(ts, gap), "upload_id")
        .agg(F.count("*").alias("acks"), F.max(ts).alias("last_at"))
        .select(
            "upload_id", F.col("session_window.start").alias("first_at"), "last_at",
            F.col("session_window.end").alias("ended_at"), "acks",
        )
    )


LETTER = "task_id string, retry_count int, error string, sent_at timestamp_ntz"
#: Buckets of letters whose task id does not tell its day.
SPREAD = 64


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to. It is made once and lies inside the checkpoint, so a
    checkpoint that was lost and begun anew, even under the same path, is another run."""
    path = os.path.join(checkpoint, "run-name")
    for mode in ("ignore", "overwrite"):  # the second only after a write that was cut off
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode(mode).text(path)
        found = spark.read.text(path).first()
        if found:
            return found[0]
    raise OSError(f"no run name can be kept in {path}")


def letter_bucket(task_id: Column) -> Column:
    """Where a letter is stored: the day its task was made, which the id holds; ids of another form are spread by hash."""
    day = F.date_format(fn.id_created_at(task_id), "yyyy-MM-dd")
    return F.coalesce(day, F.concat(F.lit("h"), F.pmod(F.xxhash64(task_id), F.lit(SPREAD)).cast("string")))


def append_dead_letters(
    letters: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Durable dead-letter table, one row per (task_id, retry_count); letters without a task id, which nothing
    tells apart, are all kept in ``<path>-nameless``.

    Letters of a key always lie in the same bucket, so a batch reads the two key columns of its own buckets only,
    not of all that was ever stored. It writes into ``run=r/batch_id=n`` of them and replaces that when it is run
    again, where r is the name kept in the checkpoint: no other run, nor this one begun anew, owns those folders.
    """
    spark = letters.sparkSession
    run = run_name(spark, checkpoint)
    nameless = f"{path}-nameless"
    for folder in (f"{path}/bucket=none", nameless):
        spark.createDataFrame([], LETTER).write.mode("overwrite").parquet(f"{folder}/run=none/batch_id=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = batch.select("task_id", "retry_count", "error", "sent_at").persist()
        own.filter(F.col("task_id").isNull()).write.mode("overwrite").parquet(f"{nameless}/run={run}/batch_id={batch_id}")
        first = own.filter(F.col("task_id").isNotNull()).groupBy("task_id", "retry_count").agg(
            F.min_by(F.struct("error", "sent_at"), F.struct("sent_at", "error")).alias("x")
        ).select("task_id", "retry_count", "x.*", letter_bucket(F.col("task_id")).alias("bucket"))
        buckets = [r[0] for r in first.select("bucket").distinct().collect()]  # days of one batch's tasks
        touched = "{" + ",".join(["none", *sorted(buckets)]) + "}"
        stored = spark.read.schema("task_id string, retry_count int, bucket string, run string, batch_id long").option(
            "basePath", path).parquet(f"{path}/bucket={touched}")
        seen = stored.filter((F.col("run") != run) | (F.col("batch_id") < batch_id)).select("task_id", F.col("retry_count").alias("_r"))
        fresh = first.join(seen, (first["task_id"] == seen["task_id"]) & first["retry_count"].eqNullSafe(seen["_r"]), "left_anti")
        (fresh.withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run", "batch_id").parquet(path))
        own.unpersist()

    return start_batches(letters, handle, checkpoint, available_now=available_now)


def retry_loop(
    failures: DataFrame, task_table: DataFrame, retry_topic: dict, dead_topic: dict,
    checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Failures (task_id, error_message, sent_at) to the retry topic or the dead-letter topic.

    Each batch is met with the task table once and kept while both topics are written. A batch
    that is run again sends its records again; ``dedup_messages`` and ``append_dead_letters``
    take each (task_id, retry_count) once.
    """
    state = task_table.select("task_id", "upload_id", "user_id", "video_url", "retry_count", "max_retry")

    def handle(batch: DataFrame, batch_id: int) -> None:
        failed = batch.select("task_id", "error_message", "sent_at").join(state, "task_id").persist()
        retries, dead = tasks.route_failures(failed, F.col("sent_at"))
        topics.publish_task_messages(retries, retry_topic)
        topics.publish_dead_letters(dead, dead_topic)
        failed.unpersist()

    return start_batches(failures, handle, checkpoint, available_now=available_now)
