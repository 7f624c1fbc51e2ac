"""Status events of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.operators.ordered import HOUR, SLICE, neighbour, with_slice

ORDER = ["ts", "seq"]


def transition_audit(events: DataFrame, slice_seconds: int = HOUR) -> DataFrame:
    """Each status with the one before it and whether the declared relation allows the move.

    A task's first event has nothing before it and counts as allowed.
    """
    moves = F.broadcast(s.declared_moves(events.sparkSession)).withColumn("_legal", F.lit(True))
    paired = neighbour(
        with_slice(events, "ts", slice_seconds), ["task_id"], ORDER, F.col("status"), "from_status"
    ).withColumnRenamed("status", "to_status")
    return (
        paired.join(moves, ["from_status", "to_status"], "left")
        .withColumn("legal", F.col("from_status").isNull() | F.coalesce("_legal", F.lit(False)))
        .drop("_legal", SLICE)
    )


def state_dwell(events: DataFrame, slice_seconds: int = HOUR) -> DataFrame:
    """Milliseconds from each event to the task's next one; null for the last."""
    ahead = neighbour(
        with_slice(events, "ts", slice_seconds), ["task_id"], ORDER, F.col("ts"), "next_ts",
        forward=True,
    )
    return ahead.withColumn("dwell_ms", fn.millis_between(F.col("ts"), F.col("next_ts"))).drop(SLICE)
