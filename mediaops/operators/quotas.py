"""Token quotas per user, by day and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaops import schemas as s
from mediaops.functions import columns as fn
from mediaops.operators.ordered import HOUR, PART, SLICE, running_totals, with_slice
from mediaops.session import materialise

def remaining(quota: str, used: str) -> Column:
    """What is left, never below 0; the whole quota if nothing was ever recorded."""
    left = F.greatest(F.lit(0), F.col(quota) - F.col(used))
    return F.when(F.col(quota).isNull() | F.col(used).isNull(), F.col(quota)).otherwise(left)


def quota_remaining(quotas: DataFrame, need: Column) -> DataFrame:
    """Remaining daily and monthly tokens, and whether both cover the need."""
    return (
        quotas.withColumn("remaining_daily", remaining("quota_daily", "used_daily"))
        .withColumn("remaining_monthly", remaining("quota_monthly", "used_monthly"))
        .withColumn(
            "enough",
            F.coalesce(
                (F.col("remaining_daily") >= need) & (F.col("remaining_monthly") >= need),
                F.lit(False),
            ),
        )
    )


def quota_reset(quotas: DataFrame, as_of: Column) -> DataFrame:
    """Quotas with counters that are due zeroed and their next reset set.

    A counter is due if its reset time is unknown or past. The next ones are the coming
    midnight and the first midnight of the coming month.
    """
    def due(column: str) -> Column:
        return F.col(column).isNull() | (F.col(column) < as_of)

    return (
        quotas.withColumn("daily_due", due("reset_daily_at"))
        .withColumn("monthly_due", due("reset_monthly_at"))
        .withColumn("used_daily", F.when(F.col("daily_due"), 0).otherwise(F.col("used_daily")))
        .withColumn("used_monthly", F.when(F.col("monthly_due"), 0).otherwise(F.col("used_monthly")))
        .withColumn(
            "reset_daily_at",
            F.when(F.col("daily_due"), fn.next_day(as_of)).otherwise(F.col("reset_daily_at")),
        )
        .withColumn(
            "reset_monthly_at",
            F.when(F.col("monthly_due"), fn.next_month(as_of)).otherwise(F.col("reset_monthly_at")),
        )
    )


def _with_periods(calls: DataFrame) -> DataFrame:
    return calls.withColumn("day", F.to_date("created_at")).withColumn(
        "month", F.trunc(F.to_date("created_at"), "month")
    )


def quota_running_usage(
    calls: DataFrame, daily: int = s.DEFAULT_QUOTA_DAILY, monthly: int = s.DEFAULT_QUOTA_MONTHLY, slice_seconds: int = HOUR
) -> DataFrame:
    """Tokens used so far in the user's day and month at each call, and whether this is the
    call that crosses either quota. One shuffle of the calls; what earlier slices of the day and the month used is carried
    by sums per slice. Choose slices of at most a day that suit one task."""
    rows = with_slice(_with_periods(calls), "created_at", slice_seconds)
    tokens = F.col("total_tokens")
    both = running_totals(rows, ["user_id", "month", "day"], ["created_at", "id"], tokens, {
        "day_tokens": ["user_id", "month", "day"], "month_tokens": ["user_id", "month"]})

    def crosses(total: str, quota: int) -> Column:
        return (F.col(total) > quota) & (F.col(total) - tokens <= quota)

    return (
        both.withColumn("crosses_daily", crosses("day_tokens", daily))
        .withColumn("crosses_monthly", crosses("month_tokens", monthly))
        .drop(SLICE)
    )


def quota_replay(
    calls: DataFrame, quotas: DataFrame | None = None, slice_seconds: int = HOUR
) -> DataFrame:
    """Each call with ``accepted``, whether both remaining quotas cover its tokens at that moment, and ``code``: 0, or
    why it is refused: the day's quota, else the month's; a call whose tokens are not known is refused as such.

    A refused call uses nothing, so no running sum can tell; and tokens may be negative. Months of
    users, calls without a user among them, are cut into slices. Of each slice only its tokens in order
    go to the chain over the month, which finds what is used when the slice begins; from there each
    slice is replayed on its own. ``quotas(user_id, quota_daily, quota_monthly)`` gives limits, else
    the defaults.
    """
    rows = _with_periods(calls)
    if quotas is not None:
        rows = rows.join(quotas.select("user_id", "quota_daily", "quota_monthly"), "user_id", "left")
    else:
        rows = rows.withColumn("quota_daily", F.lit(None)).withColumn("quota_monthly", F.lit(None))
    rows = rows.withColumn(
        "quota_daily", F.coalesce("quota_daily", F.lit(s.DEFAULT_QUOTA_DAILY)).cast("long")
    ).withColumn(
        "quota_monthly", F.coalesce("quota_monthly", F.lit(s.DEFAULT_QUOTA_MONTHLY)).cast("long")
    )
    # Compared as one struct, in which nulls are equal.
    rows = (
        with_slice(rows, "created_at", slice_seconds)
        .withColumn(PART, F.struct("user_id", "month", "day", SLICE))
        .withColumn("_tokens", F.col("total_tokens").cast("long"))
    )
    parts = rows.groupBy(PART).agg(
        F.array_sort(F.collect_list(F.struct("created_at", "id", "_tokens"))).alias("_items"),
        F.first("quota_daily").alias("quota_daily"),
        F.first("quota_monthly").alias("quota_monthly"),
    ).withColumn("_items", F.col("_items._tokens"))
    entries = materialise(
        _chain_parts(parts).withColumn("_number", F.monotonically_increasing_id()), "entries"
    )
    marked = rows.join(entries, PART).select(
        *calls.columns, "_number", "_tokens", "quota_daily", "quota_monthly", "_in_day", "_in_month",
        F.col("day").isNotNull().alias("_dated"),
    )
    return _replay_parts(marked, calls.columns)


NO_TOKENS, OVER_DAY, OVER_MONTH = 22001, 22002, 22003


def _replay(tokens, in_day: int, in_month: int, daily: int, monthly: int, dated: bool):
    """Yields for each call in order its code and what is used after it. Without a day every call begins one."""
    for need in tokens:
        if not dated:
            in_day = 0
        if need is None:
            code = NO_TOKENS
        elif need > max(0, daily - in_day):
            code = OVER_DAY
        elif need > max(0, monthly - in_month):
            code = OVER_MONTH
        else:
            code, in_day, in_month = 0, in_day + need, in_month + need
        yield code, in_day, in_month


def _chain_parts(parts: DataFrame) -> DataFrame:
    """``_in_day`` and ``_in_month`` that are used when each part begins, part after part of a month."""
    replay = _replay  # travels along by value

    def run(batches):
        import pyarrow as pa

        key = today = None
        in_day = in_month = 0
        for batch in batches:
            days, months = [], []
            for user, month, day, items, daily, monthly in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != (user, month):
                    key, today, in_day, in_month = (user, month), None, 0, 0
                if day is None or day != today:
                    today, in_day = day, 0
                days.append(in_day)
                months.append(in_month)
                need = [n for n in items if n is not None]
                left = min(daily - in_day, monthly - in_month)
                if day is not None and sum(n for n in need if n > 0) <= left:  # all fit
                    in_day, in_month = in_day + sum(need), in_month + sum(need)
                elif day is None or min(need, default=1) <= max(0, left):  # else none fits
                    for _, in_day, in_month in replay(need, in_day, in_month, daily, monthly, day is not None):
                        pass
            yield pa.RecordBatch.from_arrays(
                [batch.column(6), pa.array(days, pa.int64()), pa.array(months, pa.int64())],
                names=[PART, "_in_day", "_in_month"])

    place = F.struct(f"{PART}.user_id", f"{PART}.month")
    sent = (
        parts.repartition(place).sortWithinPartitions(PART)
        .select(f"{PART}.user_id", f"{PART}.month", f"{PART}.day", "_items", "quota_daily", "quota_monthly", PART)
    )
    out = T.StructType([sent.schema[PART], T.StructField("_in_day", T.LongType()), T.StructField("_in_month", T.LongType())])
    return sent.mapInArrow(run, out)


def _replay_parts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``accepted`` and ``code``, each part replayed from what is used when it begins."""
    replay, n = _replay, len(columns)

    def run(batches):
        import pyarrow as pa

        at, in_day, in_month = None, 0, 0
        for batch in batches:
            number, need, daily, monthly, day0, month0, dated = (batch.column(i).to_pylist() for i in range(n, n + 7))
            codes, low = [], 0
            while low < len(number):
                high = low + 1
                while high < len(number) and number[high] == number[low]:
                    high += 1
                if number[low] != at:
                    at, in_day, in_month = number[low], day0[low], month0[low]
                for code, in_day, in_month in replay(need[low:high], in_day, in_month, daily[low], monthly[low], dated[low]):
                    codes.append(code)
                low = high
            made = pa.array(codes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array([c == 0 for c in codes], pa.bool_()), made],
                names=[*columns, "accepted", "code"])

    sent = rows.repartition("_number").sortWithinPartitions("_number", "created_at", "id", "_tokens")
    out = T.StructType([*(sent.schema[c] for c in columns), T.StructField("accepted", T.BooleanType()), T.StructField("code", T.IntegerType())])
    return sent.mapInArrow(run, out)
