"""Order-dependent window work that survives a hot key.

A plain window sends all rows of a key to one task. Here each key is cut into time slices, so
the row-level window runs per (key, slice); one small row per slice carries the last value or
the total over to the later slices. The carry is joined back on (key, slice), the partitioning
the window already uses, so the detail rows are shuffled once. Keys and slice are compared as one
struct, in which nulls are equal: rows without a key or a time are a key and a slice of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.functions.columns import micros

SLICE = "_slice"
HOUR = 3600


def with_slice(df: DataFrame, ts: str, seconds: int = HOUR) -> DataFrame:
    return df.withColumn(SLICE, F.floor(micros(F.col(ts)) / (seconds * 1_000_000)))


PART = "_part"


def _parted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(PART, F.struct(*keys, SLICE))


def _over_parts(keys: list[str]):
    """All slices of a key, over rows that stand for a part."""
    return Window.partitionBy(F.struct(*(F.col(f"{PART}.{k}") for k in keys)))


def in_order(df: DataFrame, keys: list[str], order: list[str], last: str) -> DataFrame:
    """The rows of each part (keys and slice) one after another in order, with ``last`` true for its last
    row, for a pass that keeps the state of one part at a time. Adds the part as ``PART``."""
    rows = df if PART in df.columns else _parted(df, keys)
    over = Window.partitionBy(PART).orderBy(*order)
    return rows.withColumn(last, F.lead(F.lit(True)).over(over).isNull())


def whole_parts(batches, last: int):
    """Record batches of ``in_order`` joined and cut again so that each holds whole parts only. ``last`` is the
    place of the flag of a part's last row."""
    import numpy as np
    import pyarrow as pa

    held = []
    for batch in batches:
        ends = np.flatnonzero(np.asarray(batch.column(last)))
        if not len(ends):
            held.append(batch)
            continue
        cut = int(ends[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
        held = [batch.slice(cut)] if cut < batch.num_rows else []


def parts_in_order(parts: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Rows that stand for a part (``PART``), slice after slice of each key, with ``last`` true for the key's last."""
    over = _over_parts(keys).orderBy(f"{PART}.{SLICE}")
    return parts.withColumn(last, F.lead(F.lit(True)).over(over).isNull())


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
    forward: bool = False,
) -> DataFrame:
    """Adds the value of the previous row of the key (or of the next one). Needs with_slice."""
    rows = _parted(df.withColumn("_value", value), keys)
    local = Window.partitionBy(PART).orderBy(*order)
    position = F.struct(*order)
    if forward:
        edge = F.min_by("_value", position)
        over = _over_parts(keys).orderBy(F.col(f"{PART}.{SLICE}").desc())
        near = F.lead("_value").over(local)
        at_edge = F.lead(F.lit(True)).over(local).isNull()
    else:
        edge = F.max_by("_value", position)
        over = _over_parts(keys).orderBy(f"{PART}.{SLICE}")
        near = F.lag("_value").over(local)
        at_edge = F.lag(F.lit(True)).over(local).isNull()
    carry = (
        rows.groupBy(PART).agg(edge.alias("_edge"))
        .withColumn("_carried", F.lag("_edge").over(over))
        .drop("_edge")
    )
    placed = rows.withColumn("_near", near).withColumn("_at_edge", at_edge)
    return (
        placed.join(carry, PART, "left")
        .withColumn(out, F.when(F.col("_at_edge"), F.col("_carried")).otherwise(F.col("_near")))
        .drop(PART, "_value", "_near", "_at_edge", "_carried")
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], value: Column, outs: dict[str, list[str]], wholes: dict[str, list[str]] | None = None
) -> DataFrame:
    """Adds running sums of the value up to and including each row: for every name in ``outs`` over the rows
    alike in those first ``keys``, in the order of the other keys, the slice and ``order``. For every name in ``wholes`` adds
    their whole sum. Rows are shuffled once, by all keys and the slice."""
    rows = _parted(df.withColumn("_value", value), keys)
    local = Window.partitionBy(PART).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carry = rows.groupBy(PART).agg(F.sum("_value").alias("_sum"))
    for out, some in outs.items():
        before = _over_parts(some).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.withColumn(f"_carried_{out}", F.sum("_sum").over(before))
    for out, some in (wholes or {}).items():
        carry = carry.withColumn(out, F.sum("_sum").over(_over_parts(some)))
    done = rows.withColumn("_local", F.sum("_value").over(local)).join(carry.drop("_sum"), PART, "left")
    for out in outs:
        done = done.withColumn(out, F.col("_local") + F.coalesce(F.col(f"_carried_{out}"), F.lit(0)))
    return done.drop(PART, "_value", "_local", *(f"_carried_{out}" for out in outs))


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Adds the sum of the value over the key's rows up to and including this one."""
    return running_totals(df, keys, order, value, {out: keys})


def row_position(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds 1, 2, 3.. along the order within the key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out)


def trailing_count(
    df: DataFrame, keys: list[str], ts: str, window_seconds: int, out: str,
    slice_seconds: int = HOUR,
) -> DataFrame:
    """Adds the number of the key's rows in (ts - window, ts]; 0 for rows without a time.

    Counts per instant are built first. Each lands in its own slice and, if it lies within one
    window of the end, also in the next slice as context; slices are at least one window long,
    so two slices always suffice.
    """
    window = window_seconds * 1_000_000
    width = max(slice_seconds, window_seconds) * 1_000_000
    at = micros(F.col(ts))
    per_instant = df.groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("_n"))
    home = F.floor(F.col("_at") / width)
    reaches = F.floor((F.col("_at") + window - 1) / width)
    spread = per_instant.withColumn("_home", home).withColumn(
        "_in", F.explode(F.sequence(home, reaches))
    )
    w = Window.partitionBy(*keys, "_in").orderBy("_at").rangeBetween(1 - window, 0)
    counted = (
        spread.withColumn(out, F.sum("_n").over(w))
        .filter(F.col("_in") == F.col("_home"))
        .select(F.struct(*keys, "_at").alias(PART), out)
    )
    instants = df.withColumn("_at", at)
    return (
        instants.withColumn(PART, F.struct(*keys, "_at")).join(counted, PART, "left")
        .withColumn(out, F.coalesce(out, F.lit(0)))
        .drop(PART, "_at")
    )
