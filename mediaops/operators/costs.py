"""AI call log: cost, latency, attempts, failure runs, and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.columns import micros
from mediaops.operators.ordered import HOUR, PART, SLICE, in_order, parts_in_order, whole_parts, with_slice
from mediaops.operators.tasks import percentiles
from mediaops.session import materialise

ATTEMPTS_PER_DELIVERY, DELIVERIES = 4, 4


def call_cost_cube(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by every combination of user, model and day.

    Summed per full combination first; only those sums are expanded by the cube.
    """
    sums = ["input_tokens", "output_tokens", "total_tokens", "cost_amount"]
    base = calls.groupBy(
        "user_id", "model", F.to_date("created_at").cast("string").alias("day")
    ).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])
    return base.cube("user_id", "model", "day").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("calls").alias("calls"),
        *[F.sum(c).alias(c) for c in sums],
    )


def call_latency_stats(calls: DataFrame, exact: bool = True) -> DataFrame:
    """Latency percentiles and success share per model, in one reading of the log."""
    good = F.when(F.col("status") == 1, 1).otherwise(0)
    stats = percentiles(calls, ["model"], "latency_ms", exact, {"_good": good, "_calls": F.lit(1)})
    return stats.withColumn("success_share", F.col("_good") / F.col("_calls")).drop("_good", "_calls")


def attempt_budget(
    calls: DataFrame, ceiling: int = ATTEMPTS_PER_DELIVERY * DELIVERIES
) -> DataFrame:
    """Tasks with more calls than the worst case the retry rules allow."""
    return (
        calls.groupBy("task_id").agg(F.count("*").alias("calls"))
        .filter(F.col("calls") > ceiling)
        .withColumn("over_by", F.col("calls") - ceiling)
    )


RUN = "length long, first_at long, last_at long"
_NO_TIME = -(1 << 60)


def _slice_runs(rows: DataFrame) -> DataFrame:
    """Runs of failures inside each slice of a model: one row with those that touch its start (``head``) and its end
    (``tail``; ``whole`` if they are one and fill it), and one row per run between (``inner``)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for chunk in whole_parts(batches, 3):
            failed, at, last = (np.asarray(chunk.column(i)) for i in (1, 2, 3))
            ends = np.flatnonzero(last)
            starts = np.append(0, ends[:-1] + 1)
            part = np.repeat(np.arange(len(ends)), ends - starts + 1)
            edge = np.append(True, (failed[1:] != failed[:-1]) | (part[1:] != part[:-1]))
            low = np.flatnonzero(edge)
            high = np.append(low[1:], len(failed)) - 1
            low, high = low[failed[low]], high[failed[low]]
            runs = [{"length": h - l + 1, "first_at": f, "last_at": g} for l, h, f, g in zip(
                low.tolist(), high.tolist(), at[low].tolist(), at[high].tolist())]
            heads, tails, wholes, inner, inner_of = [None] * len(ends), [None] * len(ends), [False] * len(ends), [], []
            for r, l, h, p in zip(runs, low, high, part[low]):
                if l == starts[p]:
                    heads[p] = r
                if h == ends[p]:
                    tails[p] = r
                wholes[p] = wholes[p] or (l == starts[p] and h == ends[p])
                if l != starts[p] and h != ends[p]:
                    inner.append(r)
                    inner_of.append(int(ends[p]))
            none = [None] * len(inner)
            kind = pa.struct([("length", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                chunk.column(0).take(pa.array([*ends.tolist(), *inner_of], pa.int64())), pa.array(heads + none, kind), pa.array(tails + none, kind),
                pa.array(wholes + none, pa.bool_()), pa.array([None] * len(ends) + inner, kind)], names=[PART, "head", "tail", "whole", "inner"])

    kind = T.StructType.fromDDL(RUN)
    return rows.mapInArrow(run, T.StructType([
        T.StructField(PART, rows.schema[PART].dataType), T.StructField("head", kind), T.StructField("tail", kind),
        T.StructField("whole", T.BooleanType()), T.StructField("inner", kind)]))


def _joined_runs(slices: DataFrame) -> DataFrame:
    """Runs that touch an edge of a slice, joined over the slices of each model."""

    def run(batches):
        import pyarrow as pa

        def longer(one, other):
            return other if one is None else {**one, "length": one["length"] + other["length"], "last_at": other["last_at"]}

        open_ = None
        for batch in batches:
            places, found = [], []
            for i, (head, tail, whole, last) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                if whole:
                    open_ = longer(open_, head)
                else:
                    done = longer(open_, head) if head else open_
                    if done:
                        places.append(i)
                        found.append(done)
                    open_ = tail
                if last and open_:
                    places.append(i)
                    found.append(open_)
                open_ = None if last else open_
            kind = pa.struct([("length", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(found, kind)], names=[PART, "run"])

    sent = parts_in_order(slices, ["model"], "_end").select(PART, "head", "tail", "whole", "_end")
    return sent.mapInArrow(run, T.StructType([T.StructField(PART, slices.schema[PART].dataType), T.StructField("run", T.StructType.fromDDL(RUN))]))


def failure_streaks(calls: DataFrame, at_least: int = 3, slice_seconds: int = HOUR) -> DataFrame:
    """Runs of consecutive failed calls per model, in the order of (created_at, id).

    There are few models and each may hold most of the log, so it is cut into slices. A slice is summed up by the run that
    is open at its start, the one open at its end and those closed inside; only such runs go on. Calls without a time come
    first; a run of theirs has no times.
    """
    rows = with_slice(calls, "created_at", slice_seconds).select(
        "model", SLICE, "created_at", "id", F.coalesce(F.col("status") == 2, F.lit(False)).alias("_failed"),
        F.coalesce(micros(F.col("created_at")), F.lit(_NO_TIME)).alias("_at"))
    sent = in_order(rows, ["model"], ["created_at", "id"], "_last").select(PART, "_failed", "_at", "_last")
    slices = materialise(_slice_runs(sent), "runs")
    runs = slices.filter("inner IS NOT NULL").select(PART, F.col("inner").alias("run")).unionByName(
        _joined_runs(slices.filter("inner IS NULL")))

    def time(name: str):
        return F.timestamp_micros(F.nullif(F.col(f"run.{name}"), F.lit(_NO_TIME))).cast("timestamp_ntz").alias(name)

    return runs.filter(F.col("run.length") >= at_least).select(f"{PART}.model", "run.length", time("first_at"), time("last_at"))


def task_lineage(
    users: DataFrame, uploads: DataFrame, tasks: DataFrame, calls: DataFrame
) -> DataFrame:
    """One wide row per call, or per task, upload or user that has none.

    ``user_id`` in uploads and tasks holds the user's numeric ``id``. Rows without the next id meet nothing, so each looks for
    a key of its own and they spread; links without an id are left out before they are shuffled.
    """
    u = users.select(F.col("id").alias("user_id"), "username")
    up = uploads.select("user_id", "upload_id", "file_name").filter(F.col("user_id").isNotNull())
    t = tasks.select("upload_id", "task_id", F.col("status").alias("task_status")).filter(F.col("upload_id").isNotNull())
    c = calls.select("task_id", F.col("id").alias("call_id"), "model", "total_tokens").filter(F.col("task_id").isNotNull())

    def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        own = F.when(F.col(key).isNull(), F.xxhash64(*left.columns))
        keyed = right.withColumnRenamed(key, "_key").withColumn("_own", F.lit(None).cast("long"))
        far = left.withColumn("_left", own)
        return far.join(keyed, (far[key] == keyed["_key"]) & far["_left"].eqNullSafe(keyed["_own"]), "left").drop("_key", "_own", "_left")

    return (
        met(met(met(u, up, "user_id"), t, "upload_id"), c, "task_id")
        .select("user_id", "username", "upload_id", "file_name", "task_id", "task_status",
                "call_id", "model", "total_tokens")
    )
