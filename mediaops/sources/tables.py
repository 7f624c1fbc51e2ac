"""The five service tables: load with fixed schemas, write by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediaops import schemas as s


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with exactly the schema's columns and types; absent columns are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def load_tables(
    spark: SparkSession, uri: str, num_partitions: int = 64, **options: str
) -> dict[str, DataFrame]:
    """Tables by name, from a folder of Parquet tables or from a JDBC address.

    A JDBC table is read in ``num_partitions`` ranges of its ``id``, so filters and columns are
    still pushed to the database.
    """
    if not uri.startswith("jdbc:"):
        return {
            name: spark.read.schema(schema).parquet(f"{uri}/{name}")
            for name, schema in s.TABLES.items()
        }
    base = {"url": uri, **options}
    tables = {}
    for name, schema in s.TABLES.items():
        ends = spark.read.format("jdbc").options(
            **base, query=f"SELECT min(id) AS lo, max(id) AS hi FROM {name}"
        ).load().first()
        reader = spark.read.format("jdbc").options(**base, dbtable=name)
        if ends["lo"] is not None:
            reader = reader.options(
                partitionColumn="id", lowerBound=str(ends["lo"]), upperBound=str(ends["hi"]),
                numPartitions=str(num_partitions),
            )
        tables[name] = conform(reader.load(), schema)
    return tables


def write_by_date(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Parquet in year/month/day folders.

    The rebalance hint gathers each day's rows into few files and lets adaptive execution split
    a day that is too large for one task.
    """
    dated = (
        df.withColumn("year", F.date_format(ts, "yyyy"))
        .withColumn("month", F.date_format(ts, "MM"))
        .withColumn("day", F.date_format(ts, "dd"))
    )
    days = ("year", "month", "day")
    dated.hint("rebalance", *days).write.mode(mode).partitionBy(*days).parquet(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """One version of a table in a folder of its own; writing a version again replaces it alone."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The newest version, or the newest one below a number. Versions are found by folder names."""
    versions = spark.read.option("basePath", path).parquet(path).select("version")
    if below is not None:
        versions = versions.filter(F.col("version") < below)
    newest = versions.agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"no version below {below} in {path}")
    return spark.read.parquet(f"{path}/version={newest}")


def snapshot_batches(path: str, keys: list[str], as_of: Column, first: int, version: str = "version"):
    """For ``foreachBatch``: batch n makes version ``first + n`` from the newest one below it and the
    batch's changes, so a batch that is run again gives the same version."""
    from mediaops.operators.tasks import upsert_snapshot

    def handle(batch: DataFrame, batch_id: int) -> None:
        base = read_snapshot(batch.sparkSession, path, first + batch_id)
        write_snapshot(upsert_snapshot(base, batch, keys, as_of, version), path, first + batch_id)

    return handle
