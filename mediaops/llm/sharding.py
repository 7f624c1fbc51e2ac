"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import text_or_empty
from mediaops.session import materialise

SHARDS = 16


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row, in key order over all shards.

    Size is the UTF-8 bytes of the text plus one. Rows are ordered by key (null first), then CRC, then their
    place in the input. One pass deals them into key ranges, adds up sizes and rows inside each range, and stores
    the narrow rows; the totals per range (one small row each) give every range its global start. A row belongs
    to shard ``floor(start * shards / total)``, so a shard differs from its equal target by less than its largest
    row at either end. ``slot`` counts from 0 inside the shard. Shards may stay empty where single texts are
    larger than a target. Null texts have size 1 and the CRC of nothing; an empty table gives no rows.
    """
    body = text_or_empty(text)
    sized = df.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
                      F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    order = ["key", "text_crc32", "place"]
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dealt.schema["key"].dataType.simpleString()
    stored = materialise(dealt.mapInArrow(_running, f"key {kind}, size long, text_crc32 long, part int, bytes_before long, "
                                                    "rows_before long"), "ranges")

    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per key range: as many as there are shuffle partitions
    starts = totals.selectExpr(
        "part", "sum(bytes) OVER (ORDER BY part) - bytes AS start_bytes", "sum(rows) OVER (ORDER BY part) - rows AS start_rows",
        "sum(bytes) OVER () AS all_bytes")
    placed = stored.join(F.broadcast(starts), "part").select(
        "key", "size", "text_crc32", (F.col("start_rows") + F.col("rows_before")).alias("row"),
        F.expr(f"int((start_bytes + bytes_before) * {int(shards)} div all_bytes)").alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def _running(batches):
    """Sums of size and rows before each row of one ordered partition."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, n_bytes, n_rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, sizes = batch.num_rows, np.asarray(batch.column(1))
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, part, np.int32)),
             pa.array(n_bytes + ends - sizes), pa.array(n_rows + np.arange(n, dtype=np.int64))],
            names=["key", "size", "text_crc32", "part", "bytes_before", "rows_before"])
        n_bytes, n_rows = n_bytes + (int(ends[-1]) if n else 0), n_rows + n
