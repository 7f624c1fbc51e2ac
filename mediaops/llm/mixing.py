"""Mixes sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import text_or_empty
from mediaops.session import materialise

SEED = 20
#: Sources up to which the table of rates is sent to every executor; beyond, rows are joined by shuffle.
SENT_SOURCES = 10_000
#: A larger mean is drawn as the sum of so many equal parts, where exp(-mean) is still exact.
PART = 500


def rates(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text",
          total: int | None = None) -> DataFrame:
    """``source, size, rate``: the mean number of copies of each document of a source.

    Sizes are UTF-8 bytes plus one per document. ``rate = weight / all weights * total / size of the source``, so
    the expected bytes of a source are its weight's part of ``total`` (by default the size of the input). Without
    ``weights`` all sources found weigh the same; with them, sources not named get rate 0. A null source is a
    source of its own.
    """
    size = (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long")
    sizes = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["source"]), "left").select(
            sizes["source"], "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    everything = F.lit(total) if total is not None else F.expr("sum(size) OVER ()")
    return weighed.select("source", "size", (F.col("weight") / F.expr("sum(weight) OVER ()") * everything / F.col("size")).alias("rate"))


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, (str, int)) else p for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def replicate(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source",
              text: str = "text", total: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``df``, each as often as a Poisson draw with its source's rate says, in shuffled order.

    Adds ``repeats`` (copies of this row), ``copy`` (from 0) and ``mix_key`` (a 60-bit hash that orders the whole
    output at random); columns with these names are replaced. The draw inverts the Poisson distribution at
    a number hashed from seed and key (from the text where the key is null), so it repeats exactly; rows with equal keys
    get equal draws. Rows are dealt by ``mix_key`` and sorted by it in each partition, which spreads every source and
    all copies of a row. An empty table gives no rows.
    """
    mean = materialise(rates(df, weights, source, text, total), "rates")
    cdf = f"""aggregate(sequence(1, int(ceil(mean + 10 * sqrt(mean))) + 20),
        named_struct('p', exp(-mean), 'c', array(exp(-mean))),
        (s, k) -> named_struct('p', s.p * mean / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * mean / k)), s -> s.c)"""
    drawn = (mean.where("rate > 0").withColumn("parts", F.ceil(F.col("rate") / PART).cast("int"))
             .withColumn("mean", F.col("rate") / F.col("parts"))
             .select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.expr(cdf).alias("__cdf")))
    if drawn.count() <= SENT_SOURCES:
        drawn = F.broadcast(drawn)
    own = ["repeats", "copy", "mix_key"]
    kept = [c for c in df.columns if c.lower() not in own]
    # the name of a row in the draw
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty(text).cast("binary"))))
    met = df.select([F.col(f"`{c}`") for c in kept]).join(drawn, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    one = lambda j: F.size(F.filter("__cdf", lambda c: c <= _uniform(seed, "n", name, j.cast("string"))))
    counted = met.withColumn("repeats", F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda n, j: n + one(j)))
    copies = counted.where("repeats > 0").withColumn("copy", F.explode(F.expr("sequence(0, repeats - 1)")))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("o"), name, F.col("copy").cast("string")).cast("binary"))
    keyed = copies.withColumn("mix_key", F.conv(F.substring(order, 1, 15), 16, 10).cast("long"))
    return keyed.select([F.col(f"`{c}`") for c in kept] + own).repartition("mix_key").sortWithinPartitions("mix_key")
