"""State that a stream keeps per task or upload.

Python is called once for a bucket of keys, not once for a key: keys are spread over ``buckets`` by hash, and a bucket's
state is one value in RocksDB, a small Arrow table with a row per key (chunk sets: per chunk). A call sorts and
meets the bucket's rows of one micro-batch with that table in whole columns. The source's ``maxOffsetsPerTrigger`` (or
``maxFilesPerTrigger``) bounds how many rows that can be; choose ``buckets`` so that the state of one takes a few MB. It
is part of the state: a checkpoint keeps the number it was begun with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediaops import schemas as s
from mediaops.streaming.jobs import use_rocksdb, with_event_time

BUCKETS = 1024
_BUCKET = "_bucket"


def _in_buckets(df: DataFrame, key: str, buckets: int):
    return use_rocksdb(df.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))).groupBy(_BUCKET)


class _Bucket(StatefulProcessor):
    """Keeps a table per bucket. ``columns`` names its columns and their numpy types; strings are objects."""

    columns: dict[str, str] = {}
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "table binary", self.ttl_ms)

    def kept(self) -> pd.DataFrame:
        import pyarrow as pa

        found = self.table.get()
        if found is None:
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in self.columns.items()})
        return pa.ipc.open_stream(bytes(found[0])).read_all().to_pandas().astype(self.columns)

    def keep(self, rows: pd.DataFrame) -> None:
        import pyarrow as pa

        if not len(rows):
            self.table.clear()
            return
        kinds = [(n, pa.string() if kind == "object" else pa.from_numpy_dtype(kind)) for n, kind in self.columns.items()]
        whole = pa.Table.from_pandas(rows[list(self.columns)], pa.schema(kinds), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema(kinds)) as out:
            out.write_table(whole)
        self.table.update((sink.getvalue().to_pybytes(),))

    def wake_at(self, due) -> None:
        """One timer a bucket, for the first of these event times."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(due):
            self.handle.registerTimer(int(due.min()))

    def close(self) -> None:
        pass


def _coded(known: pd.Series, seen: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys as numbers, the same in both; null is a key too. The last array holds the keys by number."""
    code, names = pd.factorize(np.concatenate([known.to_numpy(object), seen.to_numpy(object)]), use_na_sentinel=False)
    names = np.where(pd.isna(names), None, names)
    return code[: len(known)], code[len(known):], names


def _ordered(batches: Iterator[pd.DataFrame], known: pd.DataFrame):
    """A bucket's events by task and time, the number of each one's task, and whether it is its task's first or last; the
    numbers of the known tasks and all tasks by number."""
    events = pd.concat(list(batches), ignore_index=True)
    held, code, names = _coded(known["task_id"], events["task_id"])
    events = events.assign(code=code).sort_values(["code", "ts", "seq"], ignore_index=True)
    code = events["code"].to_numpy()
    turn = np.flatnonzero(code[1:] != code[:-1]) + 1
    first, last = np.zeros(len(code), bool), np.zeros(len(code), bool)
    first[np.r_[0, turn]] = True
    last[np.r_[turn - 1, len(code) - 1]] = True
    return events, code, first, last, held, names


class TaskTracker(_Bucket):
    """The last status of each task; that of a settled task is forgotten ``keep_ms`` after its last event."""

    #: ``due`` is when a task is forgotten, -1 if it is not settled.
    columns = {"task_id": "object", "status": "object", "due": "int64"}

    def __init__(self, moves: frozenset, final: frozenset, keep_ms: int):
        self.moves = pd.MultiIndex.from_tuples(sorted(moves))
        self.final, self.keep_ms = sorted(final), keep_ms

    def _keep(self, known: pd.DataFrame, watermark: int) -> None:
        known = known[(known["due"] < 0) | (known["due"] > watermark)]
        self.keep(known)
        self.wake_at(known.loc[known["due"] >= 0, "due"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.kept()
        events, code, first, last, held, names = _ordered(rows, known)
        status = events["status"].to_numpy(object)
        status = np.where(pd.isna(status), None, status)
        at_first = np.full(len(names), None, object)
        at_first[held] = known["status"].to_numpy(object)
        before = np.where(first, at_first[code], np.r_[[None], status[:-1]])
        started = pd.isna(before)
        before = np.where(started, None, before)
        legal = started | (before == status) | pd.MultiIndex.from_arrays([before, status]).isin(self.moves)
        settled = np.isin(status[last].astype(str), self.final)
        due = np.where(settled, events["at_ms"].to_numpy("int64")[last] + self.keep_ms, -1)
        touched = pd.DataFrame({"task_id": names[code[last]], "status": status[last], "due": due})
        others = known[~np.isin(held, code[last])]
        self._keep(pd.concat([others, touched], ignore_index=True) if len(others) else touched, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({
            "task_id": names[code], "seq": events["seq"].to_numpy(), "from_status": before, "to_status": status, "legal": legal.astype(bool),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self.kept(), timerValues.getCurrentWatermarkInMs())
        return iter([])


def task_state(events: DataFrame, delay: str = "10 minutes", keep_hours: int = 24 * 7, buckets: int = BUCKETS) -> DataFrame:
    """Live status per task. ``events(task_id, seq, ts, status)``: every event comes out with the
    status before it and whether the declared relation allows the move; filter on ``legal`` for
    the side output of moves that should not happen.

    A task in a final status is forgotten once the watermark is ``keep_hours`` past its last event; an event that comes
    later still starts anew, with no status before it.
    """
    timed = with_event_time(events.select("task_id", "seq", "ts", "status"), "ts", delay)
    return _in_buckets(timed.withColumn("at_ms", F.unix_millis("ts")), "task_id", buckets).transformWithStateInPandas(
        TaskTracker(frozenset(s.DECLARED_MOVES), frozenset(s.FINAL_STATUSES), keep_hours * 3_600_000),
        "task_id string, seq long, from_status string, to_status string, legal boolean", "Append", "EventTime",
    )


class ChunkSet(_Bucket):
    """The chunks of the uploads, each remembered for ``ttl_ms`` by the clock."""

    columns = {"upload_id": "object", "chunk_index": "int64", "version": "int64", "at": "int64"}

    def __init__(self, keep_ms: int):
        self.ttl_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.kept()
        known = known[known["at"] + self.ttl_ms > now]
        acks = pd.concat(list(rows), ignore_index=True)
        held, code, names = _coded(known["upload_id"], acks["upload_id"])
        chunk, of = (pd.to_numeric(acks[c]).to_numpy("float64") for c in ("chunk_index", "total_chunks"))
        total = np.zeros(len(names), np.int64)
        told = np.flatnonzero(~np.isnan(of))[::-1]
        total[code[told]] = of[told]  # the first one told stays
        inside = (chunk >= 0) & (chunk < total[code])
        kept_chunk = known["chunk_index"].to_numpy()
        width = int(max(total.max(initial=0), kept_chunk.max(initial=0))) + 1
        added = np.setdiff1d(code[inside] * width + chunk[inside].astype(np.int64), held * width + kept_chunk)
        owner = added // width
        version = np.zeros(len(names), np.int64)
        np.maximum.at(version, held, known["version"].to_numpy())
        fresh = pd.DataFrame({"upload_id": names[owner], "chunk_index": added % width, "version": version[owner] + 1, "at": now})
        if len(fresh):
            self.keep(pd.concat([known, fresh], ignore_index=True) if len(known) else fresh)
        touched = np.unique(code)
        n_added = np.bincount(owner, minlength=len(names))
        done = (n_added + np.bincount(held, minlength=len(names)))[touched]
        cuts = np.cumsum(n_added[touched])[:-1]
        yield pd.DataFrame({
            "upload_id": names[touched], "version": version[touched] + 1, "added": np.split((added % width).astype(np.int32), cuts),
            "done": done, "progress": np.where(total[touched] > 0, 100 * done // np.maximum(total[touched], 1), 0),
        })


def upload_progress(acks: DataFrame, hours: float = s.SESSION_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """What each micro-batch adds to the uploads it touches: the chunks that are new, how many are there now, and the whole percent.

    ``acks(upload_id, chunk_index, total_chunks)``; chunks out of range count for nothing. A chunk is forgotten ``hours`` after it
    came, by the clock, as sessions end then. ``newest_progress`` reads what was written. Start it with
    ``idle_batches=False``: by the clock there is always another batch to run.
    """
    return _in_buckets(acks.select("upload_id", "chunk_index", "total_chunks"), "upload_id", buckets).transformWithStateInPandas(
        ChunkSet(int(hours * 3_600_000)), "upload_id string, version long, added array<int>, done int, progress int", "Append", "ProcessingTime",
    )


def newest_progress(written: DataFrame) -> DataFrame:
    """``upload_id, chunks, done, progress`` of every upload, from all that ``upload_progress`` has written."""
    latest = F.struct("version", "done")
    return written.groupBy("upload_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("added")))).alias("chunks"),
        F.max_by("done", latest).alias("done"), F.max_by("progress", latest).alias("progress"))


class StuckWatch(_Bucket):
    """Since when each task in processing has had no event."""

    columns = {"task_id": "object", "since": "int64"}

    def __init__(self, bound_ms: int):
        self.bound_ms = bound_ms

    def _settle(self, waiting: pd.DataFrame, watermark: int, proven: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
        """Alerts for what is proven and for what the watermark has passed; the rest goes on waiting."""
        over = waiting["since"] + self.bound_ms <= watermark
        left = waiting[~over]
        self.keep(left)
        self.wake_at(left["since"] + self.bound_ms - 1)  # a timer fires after its time only
        stuck = waiting[over] if proven is None else pd.concat([proven, waiting[over]], ignore_index=True)
        since = pd.to_datetime(stuck["since"].astype("int64"), unit="ms")
        yield pd.DataFrame({
            "task_id": stuck["task_id"].to_numpy(object), "since": since.to_numpy(),
            "alert_at": (since + pd.Timedelta(milliseconds=self.bound_ms)).to_numpy(),
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.kept()
        events, code, first, last, held, names = _ordered(rows, known)
        at, busy = events["at_ms"].to_numpy("int64"), (events["status"] == "PROCESSING").to_numpy(bool)
        none = np.iinfo(np.int64).max
        known_since = np.full(len(names), none)
        known_since[held] = known["since"].to_numpy()
        since = np.where(first, known_since[code], np.r_[none, np.where(busy, at, none)[:-1]])
        late = (since != none) & (at - since > self.bound_ms)
        ends = last & busy
        waiting = pd.DataFrame({"task_id": names[code[ends]], "since": at[ends]})
        others = known[~np.isin(held, code)]
        yield from self._settle(
            pd.concat([others, waiting], ignore_index=True), timerValues.getCurrentWatermarkInMs(),
            pd.DataFrame({"task_id": names[code[late]], "since": since[late]}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(self.kept(), timerValues.getCurrentWatermarkInMs())


def stuck_alerts(events: DataFrame, minutes: int = 30, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Alerts for tasks in processing with no event for longer than the bound.

    A later event proves the gap by itself; for the newest event of a task a timer waits for
    the watermark to pass the bound.
    """
    timed = with_event_time(events.select("task_id", "seq", "ts", "status"), "ts", delay)
    return _in_buckets(timed.withColumn("at_ms", F.unix_millis("ts")), "task_id", buckets).transformWithStateInPandas(
        StuckWatch(minutes * 60_000), "task_id string, since timestamp, alert_at timestamp", "Append", "EventTime",
    )
