"""A batch of task messages through the worker's steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.operators import commands, results, tasks
from mediaops.session import materialise
from mediaops.sources import topics

STARTABLE = ("PENDING", "QUEUED", "RETRYING")


@dataclass
class WorkerOutput:
    tasks: DataFrame
    retries: DataFrame
    dead_letters: DataFrame
    events: DataFrame


def run_worker(
    messages: DataFrame,
    task_table: DataFrame,
    client: Callable[[str, str], str],
    bucket: str,
    as_of: Column,
    delays: tuple[float, ...] = s.RETRY_DELAYS,
    parallelism: int | None = None,
) -> WorkerOutput:
    """Takes the messages whose task may start, calls the AI client once per task, and applies
    the outcome.

    Repeated messages of a task count once. The answers are written out before they are used, so
    nothing downstream can call the client again.
    """
    asked = messages.groupBy("task_id").agg(F.max("retry_count").alias("message_retry"))
    startable = (
        tasks.enrich_messages(asked, task_table)
        .filter((F.col("action") == "PROCESS") & F.col("task_status").isin(*STARTABLE))
        .select("task_id")
    )
    taken = task_table.join(startable, "task_id", "left_semi")
    answers = materialise(
        results.enrich_with_retry(
            taken.withColumn("video_url", fn.object_path(F.col("video_url"), bucket)), client, delays, parallelism
        ),
        "answers",
    )
    decided = answers.join(taken.select("task_id", "retry_count", "max_retry"), "task_id").withColumn(
        "can_retry", F.coalesce(F.col("retry_count") < F.col("max_retry"), F.lit(False))
    )
    after, _ = commands.apply_commands(task_table, _worker_commands(decided, as_of))
    failed = after.join(answers.filter("NOT ok").select("task_id"), "task_id", "left_semi")
    again = failed.filter(F.col("status") == "RETRYING").withColumn("retry_count", F.col("retry_count") - 1)
    dead = failed.filter(F.col("status") == "DEAD")
    kind = F.when(F.col("ok"), topics.COMPLETED).when(F.col("can_retry"), topics.RETRYING).otherwise(topics.DEAD)
    return WorkerOutput(
        tasks=after,
        retries=tasks.auto_retry_messages(again, as_of),
        dead_letters=tasks.route_failures(dead, as_of)[1],
        events=decided.select(
            "task_id", kind.alias("event"),
            F.when(F.col("ok"), "").otherwise(F.substring("error", 1, 500)).alias("detail"),
            as_of.alias("sent_at"),
        ),
    )


def _worker_commands(decided: DataFrame, as_of: Column) -> DataFrame:
    """The updates the worker makes for one task, in order."""
    ok = F.col("ok")
    ending = F.when(ok, "complete").otherwise("fail")
    then = F.when(~ok & F.col("can_retry"), "auto_retry").when(~ok, "mark_dead")

    def step(command: Column, progress: int | None = None) -> Column:
        return F.struct(command.alias("command"), F.lit(progress).cast("int").alias("progress"))

    steps = F.array(
        step(F.lit("compare_and_set")),
        step(F.lit("start")),
        step(F.lit("progress"), 10),
        step(F.lit("progress"), 20),
        step(F.when(ok, F.lit("progress")), 80),
        step(ending),
        step(then),
    )
    return (
        decided.select(
            "task_id", F.posexplode(steps).alias("seq", "step"), "result", F.col("error").alias("error_message")
        )
        .filter(F.col("step.command").isNotNull())
        .select(
            "task_id", as_of.alias("ts"), F.col("seq").cast("long").alias("seq"), "step.command",
            F.lit(None).cast("long").alias("actor_id"),
            F.lit("PENDING").alias("old_status"), F.lit("QUEUED").alias("new_status"),
            F.col("step.progress").alias("progress"),
            "error_message",
            F.lit(None).cast("string").alias("task_name"),
            "result", fn.summary_of(F.col("result")).alias("summary"),
            F.lit(0).alias("frame_count"), F.lit(0).cast("long").alias("tokens_used"),
        )
    )
