"""AI result documents, the calls that make them, and content hashes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import count, islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.functions.frames import once
from mediaops.session import materialise

_WITH_CORRUPT = StructType([*s.AI_RESULT.fields, StructField("_corrupt", StringType())])


def parse_results(tasks: DataFrame) -> DataFrame:
    """Adds ``doc`` (the parsed document) and ``parsed``; the raw text stays."""
    cleaned = once(tasks, "_text", fn.strip_fence(F.col("result")))
    parsed = once(
        cleaned, "_doc",
        F.from_json("_text", _WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    good = (
        F.col("_text").startswith("{") & F.col("_doc").isNotNull() & F.col("_doc._corrupt").isNull()
    )
    return (
        parsed.withColumn("parsed", F.coalesce(good, F.lit(False)))
        .withColumn("doc", F.when(F.col("parsed"), F.col("_doc").dropFields("_corrupt")))
        .drop("_text", "_doc")
    )


def scenes(parsed: DataFrame) -> DataFrame:
    """One row per scene with its place; a missing range shows as a dash."""
    rows = parsed.drop("doc", "parsed").columns
    return parsed.select(
        *rows, F.posexplode_outer("doc.scenes").alias("place", "scene")
    ).select(
        *rows, "place",
        F.when(
            F.col("place").isNotNull(),
            F.coalesce(F.nullif(F.col("scene.timeRange"), F.lit("")), F.lit("-")),
        ).alias("time_range"),
        F.col("scene.description").alias("description"),
        F.col("scene.type").alias("type"),
    )


def keyframes(parsed: DataFrame) -> DataFrame:
    """One row per keyframe with its place; a missing time shows as a dash."""
    rows = parsed.drop("doc", "parsed").columns
    return parsed.select(
        *rows, F.posexplode_outer("doc.keyframes").alias("place", "frame")
    ).select(
        *rows, "place",
        F.when(
            F.col("place").isNotNull(),
            F.coalesce(F.nullif(F.col("frame.time"), F.lit("")), F.lit("-")),
        ).alias("time"),
        F.col("frame.description").alias("description"),
    )


def scene_times(scene_rows: DataFrame) -> DataFrame:
    """Start, end and length in seconds of ``MM:SS-MM:SS`` ranges; null for other forms."""
    bounds = F.split("time_range", "-")
    return (
        scene_rows.withColumn("start_s", fn.clock_seconds(F.get(bounds, 0)))
        .withColumn("end_s", fn.clock_seconds(F.get(bounds, 1)))
        .withColumn("seconds", F.col("end_s") - F.col("start_s"))
    )


def scene_durations(scene_rows: DataFrame) -> DataFrame:
    """Scenes and total seconds by scene type."""
    return (
        scene_times(scene_rows).filter(F.col("type").isNotNull())
        .groupBy("type")
        .agg(F.count("*").alias("scenes"), F.sum("seconds").alias("seconds"))
    )


def sentiment_mix(parsed: DataFrame) -> DataFrame:
    sentiment = fn.sentiment_class(F.col("doc.sentiment"))
    return (
        parsed.select(sentiment.alias("sentiment")).filter(F.col("sentiment").isNotNull())
        .groupBy("sentiment").agg(F.count("*").alias("n"))
    )


def detected_text(parsed: DataFrame) -> DataFrame:
    rows = parsed.drop("doc", "parsed").columns
    return parsed.select(*rows, F.col("doc.textDetected").alias("text_detected")).filter(
        F.length("text_detected") > 0
    )


def top_tags(parsed: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tags, ties by tag."""
    return (
        parsed.select(F.explode("doc.tags").alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "tag").limit(k)
    )


# ---- calls to the AI service ----

class Answer(NamedTuple):
    """What the service says: ``code`` 200 with the body, or another code with a message."""

    code: int
    message: str | None = None
    body: str | None = None


#: Refused tasks that one partition keeps waiting; beyond them it takes no new ones until the first is due.
MOST_WAITING = 10_000


def is_rate_limit(code: int, message: str | None) -> bool:
    return code == 429 or (message is not None and "rate" in message)


def enrich_with_retry(
    tasks: DataFrame,
    client: Callable[[str, str], Answer],
    delays: tuple[float, ...] = s.RETRY_DELAYS,
    parallelism: int | None = None,
    calls_per_second: float | None = None,
) -> DataFrame:
    """Calls ``client(video_url, prompt)`` per task and records the outcome.

    A blank prompt is replaced by the default. A refusal for the rate (``is_rate_limit`` of the answer's code and message, or of
    a raised error's text) is tried again after each delay, any other error is final. Returns task_id, ok,
    attempts, result, error.

    A refused task waits with a due time while the partition goes on with others; it only sleeps when nothing else is
    left to do, so delays of many tasks pass together. ``parallelism`` bounds the calls in flight, and
    ``calls_per_second``, which needs it, those of the whole job. A task may be called again if its executor is lost, so
    the client should answer repeats from a cache keyed by task and prompt.
    """
    if calls_per_second and not parallelism:
        raise ValueError("calls_per_second is shared by the partitions: say how many with parallelism")
    prompt = F.when(fn.filled(F.col("prompt")), F.col("prompt")).otherwise(s.DEFAULT_PROMPT)
    rows = tasks.select("task_id", "video_url", prompt.alias("prompt"))
    if parallelism:
        rows = rows.repartition(parallelism, "task_id")
    pause = parallelism / calls_per_second if calls_per_second else 0.0
    refused, columns = is_rate_limit, ["task_id", "ok", "attempts", "result", "error"]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, order, free_at = [], count(), 0.0

        def attempt(number: int, task: str, url: str, text: str) -> tuple | None:
            """The outcome, or none if the task waits for another attempt."""
            nonlocal free_at
            if pause:
                time.sleep(max(0.0, free_at - time.monotonic()))
                free_at = time.monotonic() + pause
            try:
                code, message, body = client(url, text)
            except Exception as error:
                code, message, body, said = 0, str(error), None, str(error)
            else:
                said = f"code={code}, msg={message}"
            if code == 200:
                return task, True, number, body, None
            if not refused(code, message):
                return task, False, number, None, f"AI call failed: {said}"
            if number > len(delays):
                return task, False, number, None, f"AI call failed after {len(delays)} retries"
            heappush(waiting, (time.monotonic() + delays[number - 1], next(order), number + 1, task, url, text))
            return None

        def due(until_most: int) -> Iterator[tuple]:
            """Outcomes of tasks whose time has come; sleeps while more than ``until_most`` wait."""
            while waiting and (len(waiting) > until_most or waiting[0][0] <= time.monotonic()):
                time.sleep(max(0.0, waiting[0][0] - time.monotonic()))
                done = attempt(*heappop(waiting)[2:])
                if done:
                    yield done

        for batch in batches:
            found = []
            for task, url, text in zip(batch["task_id"], batch["video_url"], batch["prompt"]):
                found += due(MOST_WAITING)
                done = attempt(1, task, url, text)
                found += [done] if done else []
            yield pd.DataFrame(found, columns=columns)
        while waiting:
            yield pd.DataFrame(list(islice(due(0), MOST_WAITING)), columns=columns)

    return rows.mapInPandas(
        call, "task_id string, ok boolean, attempts int, result string, error string"
    )


def split_outcomes(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed). The outcomes are written out first, so reading both results does not
    call the service twice."""
    kept = materialise(enriched, "outcomes")
    return kept.filter("ok"), kept.filter("NOT ok")


# ---- content ----

def verify_content(content: DataFrame, sessions: DataFrame, digest: Column) -> DataFrame:
    """Declared hash of each upload against the one computed from its content.

    The hash is computed before the join, so only the digest is shuffled, not the content.
    """
    hashed = content.select("upload_id", digest.alias("actual_hash"))
    return sessions.join(hashed, "upload_id", "left").select(
        "upload_id", "file_hash", "actual_hash",
        F.when(F.col("actual_hash").isNull(), "NO_CONTENT")
        .when(F.col("file_hash").isNull(), "NOT_DECLARED")
        .when(F.lower("file_hash") == F.col("actual_hash"), "MATCH")
        .otherwise("MISMATCH")
        .alias("outcome"),
    )
