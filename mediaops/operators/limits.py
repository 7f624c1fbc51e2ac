"""Request rates, audited after the fact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops.functions.columns import micros
from mediaops.operators.ordered import (
    HOUR, PART, SLICE, in_order, parts_in_order, row_position, trailing_count, whole_parts, with_slice,
)

NEVER = -(1 << 60)
GLOBAL_LIMIT, USER_LIMIT, UPLOAD_LIMIT = 1000, 100, 10
MICROS = 1_000_000


def _bucket(seconds: int):
    return F.floor(micros(F.col("ts")) / (seconds * MICROS))


def rate_global(requests: DataFrame, limit: int = GLOBAL_LIMIT, seconds: int = 1) -> DataFrame:
    """Clock-aligned windows whose total exceeds the ceiling."""
    return (
        requests.groupBy(_bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .withColumn("window_start", (F.col("bucket") * seconds).cast("long"))
        .drop("bucket")
    )


def _threshold(limit: int | str) -> Column:
    """A number for all, or the column that holds each request's own limit."""
    return F.col(limit) if isinstance(limit, str) else F.lit(limit)


def rate_aligned(
    requests: DataFrame, keys: list[str], limit: int | str = USER_LIMIT, seconds: int = 1,
    slice_seconds: int = HOUR,
) -> DataFrame:
    """Place of each request in its key's clock-aligned window, and whether it is allowed.

    Windows are numbered slice by slice. Requests without a key or a time share a window.
    ``limit`` may name a column.
    """
    bucketed = with_slice(requests.withColumn("bucket", _bucket(seconds)), "ts", slice_seconds)
    placed = row_position(bucketed, [*keys, "bucket"], ["ts", "req_id"], "place")
    return placed.withColumn("allowed", F.col("place") <= _threshold(limit)).drop("bucket", SLICE)


def sliding_rate(
    requests: DataFrame, keys: list[str], limit: int | str = USER_LIMIT, seconds: int = 1
) -> DataFrame:
    """Requests of the key in the trailing window, and whether that is over the limit, which may
    be a column's name."""
    return trailing_count(requests, keys, "ts", seconds, "in_window").withColumn(
        "over_limit", F.col("in_window") > _threshold(limit)
    )


# ---- windows anchored at the first request after the last one ended ----
#
# A key's requests are cut into time slices. Where the chain of windows leaves a slice depends only
# on the instant from which a new window may open, and that lies within one window of the slice's
# start. So a slice is summed up by a short table over the requests that may come first: up to
# which instant they enter, when the last window then ends, and how many requests it holds so far.
# One pass makes the tables of many slices at once, one carries state over the slices of a key, one
# places the requests. The passes work on flat arrays; a slice is all that is ever held together.

def _window_links(at: np.ndarray, last: np.ndarray, width: int):
    """``(first, stop, follow)`` of every row: where its part begins and ends, and, if a window opens at
    this row, which row of the part opens the next one (or the part's end)."""
    ends = np.flatnonzero(last) + 1
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    first, stop = np.repeat(starts, sizes), np.repeat(ends, sizes)
    since = at - at[first]
    stride = int(since.max(initial=0)) + width + 1
    line = np.repeat(np.arange(len(ends)), sizes) * stride + since
    follow = np.minimum(np.searchsorted(line, line + width, side="left"), stop)
    return first, stop, follow


def _last_openers(follow: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The row that opens the part's last window, for a window that opens at each row; by pointer doubling."""
    here = np.arange(len(follow))
    jump = np.where(follow < stop, follow, here)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def rate_anchored(
    requests: DataFrame, key: str, limit: int | str = USER_LIMIT, seconds: int = 1,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Window start, place in the window and whether allowed, where a window opens at the first
    request after the previous one ended. Every request counts, also a refused one. Requests
    without a key or a time are not limited: they are allowed, with no window and no place.

    Choose slices that suit one task; they hold at least one window.
    """
    width = seconds * MICROS
    slice_seconds = max(slice_seconds or max(HOUR, 64 * seconds), seconds)
    limited = F.col(key).isNotNull() & F.col("ts").isNotNull()
    sliced = with_slice(requests.filter(limited).withColumn("_at", micros(F.col("ts"))), "ts", slice_seconds)
    order = ["ts", "req_id"]
    sent = in_order(sliced, [key], order, "_last")
    entries = _enter_slices(_slice_tables(sent.select(PART, "_at", "_last"), width), key, width)
    placed = (
        _place(in_order(sliced.withColumn(PART, F.struct(key, SLICE)).join(entries, PART), [key], order, "_last"), requests.columns, width)
        .withColumn("window_start", F.timestamp_micros("opened_at").cast("timestamp_ntz"))
        .withColumn("allowed", F.col("place") <= _threshold(limit))
        .select(*requests.columns, "window_start", "place", "allowed")
    )
    free = requests.filter(~limited).select(
        *requests.columns, F.lit(None).cast("timestamp_ntz").alias("window_start"),
        F.lit(None).cast("long").alias("place"), F.lit(True).alias("allowed"),
    )
    return placed.unionByName(free)


def _slice_tables(rows: DataFrame, width: int) -> DataFrame:
    """Per part its number of rows and, for entries in order, ``upto``, ``leaves`` and ``held``."""
    links, openers = _window_links, _last_openers

    def run(batches):
        import pyarrow as pa

        for chunk in whole_parts(batches, 2):
            at, last = np.asarray(chunk.column(1)), np.asarray(chunk.column(2))
            first, stop, follow = links(at, last, width)
            opener = openers(follow, stop)
            # The chain enters at the latest at the first instant one window after the first one.
            entry = np.arange(len(at)) <= follow[first]
            group = first * (len(at) + 1) + opener
            keep = np.flatnonzero(entry & ~np.append(entry[1:] & (group[1:] == group[:-1]), False))
            ends = np.flatnonzero(last)
            counts = np.bincount(np.searchsorted(ends, keep), minlength=len(ends))
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
                at[keep], at[opener[keep]] + width, (stop[keep] - opener[keep]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).take(pa.array(ends)), pa.array((ends + 1 - first[ends]).astype(np.int64)), *lists],
                names=[PART, "n", "upto", "leaves", "held"])

    longs = T.ArrayType(T.LongType())
    return rows.mapInArrow(run, T.StructType([
        T.StructField(PART, rows.schema[PART].dataType), T.StructField("n", T.LongType()), *(T.StructField(c, longs) for c in ("upto", "leaves", "held"))]))


def _enter_slices(tables: DataFrame, key: str, width: int) -> DataFrame:
    """Per part the instant from which a new window may open when it begins, and how many requests the window that
    is still open holds."""
    never = NEVER

    def run(batches):
        import pyarrow as pa

        free_from, held = never, 0
        for batch in batches:
            n, upto, leaves, tail, last = (batch.column(i).to_pylist() for i in range(1, 6))
            entered, carried = [], []
            for i in range(batch.num_rows):
                entered.append(free_from)
                carried.append(held)
                at = int(np.searchsorted(upto[i], free_from, side="left"))
                if at < len(upto[i]):
                    free_from, held = leaves[i][at], tail[i][at]
                else:
                    held += n[i]
                if last[i]:
                    free_from, held = never, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(entered, pa.int64()), pa.array(carried, pa.int64())], names=[PART, "_free_from", "_carried"])

    sent = parts_in_order(tables, [key], "_end").select(PART, "n", "upto", "leaves", "held", "_end")
    return sent.mapInArrow(run, T.StructType([
        T.StructField(PART, tables.schema[PART].dataType), T.StructField("_free_from", T.LongType()), T.StructField("_carried", T.LongType())]))


def _place(rows: DataFrame, columns: list[str], width: int) -> DataFrame:
    """The rows with ``opened_at`` and ``place``."""
    links, n = _window_links, len(columns)

    def run(batches):
        import pyarrow as pa

        for chunk in whole_parts(batches, n + 1):
            at, last, free_from, carried = (np.asarray(chunk.column(n + i)) for i in range(4))
            first, stop, follow = links(at, last, width)
            here = np.arange(len(at))
            # the first row that opens a window, then round by round the next one of every part
            opens = at >= free_from
            now = np.flatnonzero(opens & ((here == first) | ~np.append(False, opens[:-1])))
            opener = np.full(len(at), -1)
            while len(now):
                opener[now] = now
                now = follow[now[follow[now] < stop[now]]]
            opener = np.maximum.accumulate(np.where(opener < 0, -1, opener))
            own = opener >= first
            opened = np.where(own, at[np.maximum(opener, 0)], free_from - width)
            place = np.where(own, here - opener + 1, carried + here - first + 1)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(i) for i in range(n)] + [pa.array(opened), pa.array(place.astype(np.int64))],
                names=[*columns, "opened_at", "place"])

    sent = rows.select(*columns, "_at", "_last", "_free_from", "_carried")
    return sent.mapInArrow(run, T.StructType([
        *(sent.schema[c] for c in columns), T.StructField("opened_at", T.LongType()), T.StructField("place", T.LongType())]))
