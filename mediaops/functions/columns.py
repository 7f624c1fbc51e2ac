"""Column functions: plain expressions, evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaops import schemas as s

FENCE_OPEN = r"^```(?:json)?\n?"
FENCE_CLOSE = r"\n?```$"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 in the session zone, which the jobs pin."""
    return F.unix_micros(ts.cast("timestamp"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, truncated toward zero; null if either is null."""
    return ((micros(end) - micros(start)) / 1000).cast("long")


def filled(text: Column) -> Column:
    """True if the text has a visible character; false for null."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def lookup(values: dict, key: Column) -> Column:
    """A fixed mapping as an expression; null for a missing key."""
    result = F.lit(None)
    for k, v in reversed(list(values.items())):
        result = F.when(key == F.lit(k), F.lit(v)).otherwise(result)
    return result


def mask_key(key: Column) -> Column:
    """First 8 and last 4 characters; keys under 12 characters and nulls show nothing."""
    return F.when(
        F.length(key) >= 12, F.concat(F.substring(key, 1, 8), F.lit("***"), F.right(key, F.lit(4)))
    ).otherwise("***")


def object_path(url: Column, bucket: str) -> Column:
    """Path inside the bucket: a leading slash goes, and then a leading bucket name."""
    return F.coalesce(F.regexp_replace(url, f"^/(?:{bucket}/)?", ""), F.lit(""))


def id_created_at(ident: Column) -> Column:
    """Instant held in an upload or task id; null if the id has another form."""
    seconds = F.regexp_extract(ident, r"^(?:upload|task)_(\d+)_", 1)
    return F.when(
        F.length(seconds) > 0, F.timestamp_seconds(seconds.cast("long") + s.ID_EPOCH_SECONDS)
    )


def extension(name: Column) -> Column:
    """Lower-case text after the last dot of the base name; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def chunk_count(size: Column, chunk: Column) -> Column:
    return F.ceil(size / chunk).cast("int")


def last_chunk_bytes(size: Column, chunk: Column) -> Column:
    return size - (chunk_count(size, chunk).cast("long") - 1) * chunk


def chunk_path(upload_id: Column, index: Column) -> Column:
    return F.concat(F.lit("chunks/"), upload_id, F.lit("/chunk_"), index.cast("string"))


def video_path(upload_id: Column, file_name: Column, day: Column) -> Column:
    return F.concat(
        F.lit("videos/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), upload_id, F.lit("."),
        extension(file_name),
    )


def chunk_list(json_text: Column) -> Column:
    """Uploaded chunk indices from their JSON text; empty for null or blank."""
    return F.coalesce(F.from_json(json_text, "array<int>"), F.array().cast("array<int>"))


def add_chunk(chunks: Column, index: Column) -> Column:
    return F.when(F.array_contains(chunks, index), chunks).otherwise(
        F.array_append(chunks, index)
    )


def percent(done: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 if the total is null or 0."""
    return F.when(total > 0, F.floor(done * 100.0 / total)).otherwise(0).cast("int")


def size_label(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, ties up, from whole-number arithmetic."""

    def tenths(unit: int) -> Column:
        t = F.floor((size * 10 + unit // 2) / unit).cast("long")
        return F.concat(
            F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")
        )

    return (
        F.when(size == 0, "0 B")
        .when(size < 1024, F.concat(tenths(1), F.lit(" B")))
        .when(size < 1024**2, F.concat(tenths(1024), F.lit(" KB")))
        .when(size < 1024**3, F.concat(tenths(1024**2), F.lit(" MB")))
        .when(size.isNotNull(), F.concat(tenths(1024**3), F.lit(" GB")))
    )


def strip_fence(text: Column) -> Column:
    """Trimmed text without a surrounding Markdown code fence."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(
        trimmed.startswith("```"),
        F.regexp_replace(F.regexp_replace(trimmed, FENCE_OPEN, ""), FENCE_CLOSE, ""),
    ).otherwise(trimmed)


def quoted_summary(text: Column) -> Column:
    """First quoted text after the summary key, found by pattern; empty if none."""
    return F.regexp_extract(text, r'(?s)"summary".[^"]*"([^"]+)"', 1)


def summary_of(text: Column, by_pattern_only: bool = False) -> Column:
    """Summary of a result: from the JSON, else by pattern, else the first 200 characters."""
    found = quoted_summary(text)
    short = F.substring(text, 1, 200)
    by_pattern = F.when(F.length(found) > 0, found).otherwise(short)
    if by_pattern_only:
        return F.coalesce(by_pattern, F.lit(""))
    parsed = F.get_json_object(strip_fence(text), "$.summary")
    return F.coalesce(F.when(F.length(parsed) > 0, parsed), by_pattern, F.lit(""))


def sentiment_class(sentiment: Column) -> Column:
    """positive, negative or neutral; null if there is no sentiment."""
    low = F.lower(sentiment)
    return (
        F.when(F.length(sentiment) == 0, None)
        .when(sentiment.contains("正") | low.contains("positive"), "positive")
        .when(sentiment.contains("负") | low.contains("negative"), "negative")
        .when(sentiment.isNotNull(), "neutral")
    )


def clock_seconds(text: Column) -> Column:
    """Seconds of ``MM:SS``; null for any other form."""
    minutes = F.regexp_extract(text, r"^(\d+):(\d\d)$", 1)
    seconds = F.regexp_extract(text, r"^(\d+):(\d\d)$", 2)
    return F.when(F.length(minutes) > 0, minutes.cast("int") * 60 + seconds.cast("int"))


def next_day(ts: Column) -> Column:
    return (F.to_date(ts) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")


def next_month(ts: Column) -> Column:
    return F.add_months(F.trunc(F.to_date(ts), "month"), 1).cast("timestamp_ntz")
