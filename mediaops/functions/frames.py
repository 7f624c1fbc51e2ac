"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is evaluated once per row. As the output of a generator it is
    not copied into every later filter and projection that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def touched(df: DataFrame, changed: Column, as_of: Column) -> DataFrame:
    """Sets ``updated_at`` to the given moment where a row changed; elsewhere it stays (null if there was none)."""
    before = F.col("updated_at") if "updated_at" in df.columns else F.lit(None)
    return df.withColumn("updated_at", F.when(changed, as_of).otherwise(before))
