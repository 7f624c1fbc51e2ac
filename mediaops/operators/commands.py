"""Guarded task updates replayed in order.

Commands of a task take effect in (ts, seq) order, and whether one applies depends on the
status the earlier ones left. So a command is a small table "status before -> status after", and
tables compose. Commands are cut into slices of a task's time: one pass composes the tables of
each slice, one carries the status from slice to slice of a task, and one replays each slice from the
status it begins with. Every pass reads rows in order and keeps one status or one table; the
payload of the commands stays aside and is met by (task_id, ts, seq) at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops import schemas as s
from mediaops.operators.ordered import HOUR, PART, SLICE, in_order, parts_in_order, with_slice
from mediaops.session import materialise

# A task may also have no status at all: the last state.
STATES = (*s.TASK_STATUSES, None)
INDEX = {name: i for i, name in enumerate(STATES)}
COMMANDS = (
    "compare_and_set", "start", "complete", "fail", "auto_retry", "mark_dead", "progress",
    "rename", "manual_retry", "delete",
)
PAYLOAD = ("new_status", "progress", "error_message", "task_name", "result", "summary",
           "frame_count", "tokens_used")

# Statuses a command needs, and the status it sets. A command not listed sets no status.
GUARDS = {
    "start": ("QUEUED", "RETRYING"),
    "manual_retry": ("FAILED", "DEAD"),
    "delete": ("COMPLETED", "DEAD", "CANCELLED"),
}
TARGETS = {
    "start": "PROCESSING", "complete": "COMPLETED", "fail": "FAILED", "auto_retry": "RETRYING",
    "mark_dead": "DEAD", "manual_retry": "PENDING", "delete": "CANCELLED",
}
OWNER_ONLY = ("rename", "manual_retry", "delete")


def _index(status: Column) -> Column:
    """Position of a status in the list; the last one for null or an unknown text."""
    at = F.array_position(F.array(*[F.lit(x) for x in s.TASK_STATUSES]), status) - 1
    return F.when(at >= 0, at).otherwise(INDEX[None]).cast("int")


def _code() -> Column:
    """What decides a command's effect, in one number: its kind, whether the owner asks, and the statuses it names."""
    kind = F.array_position(F.array(*[F.lit(x) for x in COMMANDS]), F.col("command"))
    mine = F.col("actor_id").eqNullSafe(F.col("owner_id")).cast("int")
    old = F.when(F.col("old_status").isNull(), INDEX[None]).otherwise(
        F.coalesce(F.array_position(F.array(*[F.lit(x) for x in s.TASK_STATUSES]), F.col("old_status")) - 1, F.lit(-1)))
    known = F.when(old >= 0, old).otherwise(len(STATES))  # a status that does not exist equals none
    return (((F.coalesce(kind, F.lit(0)) * 2 + mine) * (len(STATES) + 1) + known) * len(STATES) + _index(F.col("new_status"))).cast("int")


def _effects() -> tuple[list[bytes], list[bytes]]:
    """For every code a table of the status after each status, and one of where the command applies; as bytes,
    so that ``translate`` composes tables."""
    leads, applies = [], []
    for kind in (None, *COMMANDS):
        for mine in (False, True):
            for old in (*STATES, "no such status"):
                for new in STATES:
                    flags = []
                    for status in STATES:
                        if kind == "compare_and_set":
                            flags.append(status is not None and status == old)
                        else:
                            flags.append((mine or kind not in OWNER_ONLY) and status in GUARDS.get(kind, STATES))
                    target = new if kind == "compare_and_set" else TARGETS.get(kind)
                    sets = kind == "compare_and_set" or kind in TARGETS
                    after = [INDEX[target] if flag and sets else i for i, flag in enumerate(flags)]
                    leads.append(bytes(after) + bytes(range(len(after), 256)))
                    applies.append(bytes(flags))
    return leads, applies


def _composed(rows: DataFrame) -> DataFrame:
    """Per part the table that all its commands make together, and the task's first status."""
    effects, n = _effects, len(STATES)

    def run(batches):
        import pyarrow as pa

        leads, _ = effects()
        table = identity = bytes(range(n))
        for batch in batches:
            ends, tables = [], []
            for i, (code, last) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                table = table.translate(leads[code])
                if last:
                    ends.append(i)
                    tables.append(table)
                    table = identity
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(tables, pa.binary())], names=[PART, "first", "leads_to"])

    return rows.select(PART, "first", "code", "_last").mapInArrow(run, T.StructType([
        T.StructField(PART, rows.schema[PART].dataType), T.StructField("first", T.IntegerType()), T.StructField("leads_to", T.BinaryType())]))


def _entered(tables: DataFrame) -> DataFrame:
    """Per part the status it begins with, carried over the slices of each task."""

    def run(batches):
        import pyarrow as pa

        status = None
        for batch in batches:
            begins = []
            for first, table, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                status = first if status is None else status
                begins.append(status)
                status = None if last else table[status]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begins, pa.int32())], names=[PART, "begins"])

    sent = parts_in_order(tables, ["task_id"], "_end").select(PART, "first", "leads_to", "_end")
    return sent.mapInArrow(run, T.StructType([T.StructField(PART, tables.schema[PART].dataType), T.StructField("begins", T.IntegerType())]))


def _replayed(rows: DataFrame) -> DataFrame:
    """``_at`` of each command with the status before and after it, and whether it applied."""
    effects, names = _effects, list(STATES)

    def run(batches):
        import pyarrow as pa

        leads, applies = effects()
        status = None
        for batch in batches:
            before, after, applied = [], [], []
            for code, begins, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                status = begins if status is None else status
                before.append(names[status])
                applied.append(applies[code][status])
                status = leads[code][status]
                after.append(names[status])
                status = None if last else status
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(applied, pa.int32())],
                names=["_at", "status_before", "status_after", "applied"])

    sent = rows.select("_at", "code", "begins", "_last")
    text, number = T.StringType(), T.IntegerType()
    return sent.mapInArrow(run, T.StructType([
        sent.schema["_at"], T.StructField("status_before", text), T.StructField("status_after", text), T.StructField("applied", number)]))


def replay_commands(tasks: DataFrame, commands: DataFrame, slice_seconds: int = HOUR) -> DataFrame:
    """Each command on a known task with the status before and after, and ``applied``: the 0/1
    count of updated rows. Commands on unknown tasks are reported with 0.

    ``commands``: task_id, ts, seq, command, actor_id, old_status and the payload columns; (ts, seq) names a
    command of a task. Choose slices whose commands of one task suit one Spark task.
    """
    known = tasks.select("task_id", F.col("user_id").alias("owner_id"), _index(F.col("status")).alias("first"))
    at = F.struct("task_id", "ts", "seq")
    rows = with_slice(commands, "ts", slice_seconds).join(known, "task_id").select(
        F.struct("task_id", SLICE).alias(PART), "ts", "seq", "first", _code().alias("code"), at.alias("_at"))
    begins = _entered(_composed(in_order(rows, [], ["ts", "seq"], "_last")))
    done = _replayed(in_order(rows.join(begins, PART), [], ["ts", "seq"], "_last"))
    return commands.withColumn("_at", at).join(done, "_at", "left").select(
        "task_id", "ts", "seq", "command", *PAYLOAD, "status_before", "status_after", F.coalesce("applied", F.lit(0)).alias("applied"))


def tasks_after(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The tasks with the effect of the applied outcomes.

    Each field takes the value its last applied setter gave: one combinable aggregate per task.
    The retry count restarts at the last applied manual retry, so automatic retries are counted
    from there.
    """
    applied = outcomes.filter(F.col("applied") == 1)
    kind, place = F.col("command"), F.struct("ts", "seq")

    def last(out: str, setters: dict[str, Column]) -> Column:
        value = F.lit(None)
        for name, given in setters.items():
            value = F.when(kind == name, given).otherwise(value)
        return F.max_by(F.struct(value.alias("v")), F.when(kind.isin(*setters), place)).alias(out)

    c, null, zero = F.col, F.lit(None), F.lit(0)
    error = F.substring("error_message", 1, 500)
    setters = {
        "progress": {"progress": c("progress"), "complete": F.lit(100), "manual_retry": zero},
        "error_message": {"fail": error, "mark_dead": error, "manual_retry": null},
        "started_at": {"start": c("ts"), "manual_retry": null},
        "completed_at": {"complete": c("ts"), "manual_retry": null},
        "task_name": {"rename": c("task_name")},
        "result": {"complete": c("result")},
        "summary": {"complete": c("summary")},
        "frame_count": {"complete": c("frame_count")},
        "tokens_used": {"complete": c("tokens_used")},
    }
    changed = applied.groupBy("task_id").agg(
        F.max_by("status_after", place).alias("_status"),
        F.max("ts").alias("_updated_at"),
        F.max(F.when(kind == "manual_retry", place)).alias("_reset"),
        *[last(f"_{name}", given) for name, given in setters.items()],
    )
    autos = applied.filter(kind == "auto_retry").select("task_id", place.alias("_place"))
    retried = (
        autos.join(changed.select("task_id", "_reset"), "task_id")
        .filter(F.col("_reset").isNull() | (F.col("_place") > F.col("_reset")))
        .groupBy("task_id").agg(F.count("*").alias("_retries"))
    )
    joined = tasks.join(changed, "task_id", "left").join(retried, "task_id", "left")
    updates = {
        "status": F.coalesce("_status", "status"),
        "updated_at": F.coalesce("_updated_at", "updated_at"),
        "retry_count": (
            F.when(F.col("_reset").isNotNull(), 0).otherwise(F.col("retry_count"))
            + F.coalesce("_retries", F.lit(0))
        ).cast("int"),
        **{
            name: F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}.v")).otherwise(F.col(name))
            for name in setters
        },
    }
    return joined.select(
        *[updates[name].alias(name) if name in updates else F.col(name) for name in tasks.columns]
    )


def apply_commands(tasks: DataFrame, commands: DataFrame, slice_seconds: int = HOUR) -> tuple[DataFrame, DataFrame]:
    """(tasks after the commands, outcomes). The outcomes are written once to the shared
    folder, since both results read them."""
    outcomes = materialise(replay_commands(tasks, commands, slice_seconds), "outcomes")
    return tasks_after(tasks, outcomes), outcomes
