"""Topics of JSON records: read them typed, write them as the service does.

``options`` names the transport. ``{"format": "kafka", "kafka.bootstrap.servers": .., "subscribe":
..}`` is the production form (a writer gives ``topic``); ``{"format": "text", "path": ..}`` reads
and writes the same records as lines of text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from mediaops import schemas as s
from mediaops.functions.frames import once

# Record field -> column. A record's time is in epoch milliseconds.
FIELDS = {
    "taskId": "task_id", "uploadId": "upload_id", "userId": "user_id", "videoUrl": "video_url",
    "videoDuration": "video_duration", "retryCount": "retry_count", "timestamp": "sent_at",
    "priority": "priority", "analysisType": "analysis_type", "prompt": "prompt",
    "event": "event", "detail": "detail", "error": "error",
}
COMPLETED, RETRYING, DEAD = "COMPLETED", "RETRYING", "DEAD"


def _values(spark: SparkSession, options: dict, streaming: bool) -> DataFrame:
    options = dict(options)
    kind = options.pop("format", "kafka")
    reader = (spark.readStream if streaming else spark.read).format(kind).options(**options)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_topic(
    spark: SparkSession, schema: StructType, options: dict, streaming: bool = True
) -> DataFrame:
    """Typed records; ``corrupt`` holds the text of a record that is not valid JSON."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )

    def column(name: str) -> Column:
        value = F.col(f"r.{name}")
        return (F.timestamp_millis(value) if name == "timestamp" else value).alias(FIELDS[name])

    return (
        once(_values(spark, options, streaming), "r", parsed)
        .select(*[column(f.name) for f in schema.fields], F.col("r._corrupt").alias("corrupt"))
    )


def read_task_messages(spark: SparkSession, options: dict, streaming: bool = True) -> DataFrame:
    return read_topic(spark, s.TASK_MESSAGE, options, streaming)


def read_task_events(spark: SparkSession, options: dict, streaming: bool = True) -> DataFrame:
    return read_topic(spark, s.TASK_EVENT, options, streaming)


def read_dead_letters(spark: SparkSession, options: dict, streaming: bool = True) -> DataFrame:
    return read_topic(spark, s.DEAD_LETTER, options, streaming)


def as_records(df: DataFrame, schema: StructType) -> DataFrame:
    """Key and JSON value of each row; the key is the task id, so a task keeps its order."""
    have = set(df.columns)

    def field(name: str, kind) -> Column:
        column = FIELDS[name]
        if column not in have:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(column)
        if name == "timestamp":
            value = F.unix_millis(value.cast("timestamp"))
        return value.cast(kind).alias(name)

    record = F.struct(*[field(f.name, f.dataType) for f in schema.fields])
    return df.select(F.col("task_id").alias("key"), F.to_json(record).alias("value"))


def publish(
    records: DataFrame, options: dict, checkpoint: str | None = None, available_now: bool = False
) -> StreamingQuery | None:
    """Writes records; a stream needs a checkpoint folder and returns its running query."""
    options = dict(options)
    kind = options.pop("format", "kafka")
    rows = records if kind == "kafka" else records.select("value")
    if not records.isStreaming:
        rows.write.format(kind).options(**options).mode("append").save()
        return None
    writer = rows.writeStream.format(kind).options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def publish_task_messages(df: DataFrame, options: dict, **kwargs) -> StreamingQuery | None:
    return publish(as_records(df, s.TASK_MESSAGE), options, **kwargs)


def publish_task_events(df: DataFrame, options: dict, **kwargs) -> StreamingQuery | None:
    """Only the three events the worker sends; a missing detail becomes empty text."""
    known = df.filter(F.col("event").isin(COMPLETED, RETRYING, DEAD)).withColumn(
        "detail", F.coalesce("detail", F.lit(""))
    )
    return publish(as_records(known, s.TASK_EVENT), options, **kwargs)


def publish_dead_letters(df: DataFrame, options: dict, **kwargs) -> StreamingQuery | None:
    filled = df.withColumn("error", F.coalesce("error", F.lit("")))
    return publish(as_records(filled, s.DEAD_LETTER), options, **kwargs)
