"""Collects the registered jobs and their oracle SQL."""

from __future__ import annotations

import os
import pkgutil
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The frames one job reads: fixture views by name, or the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def cores(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def __call__(self, name: str) -> DataFrame:
        if name in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, name)
        return fixtures.table(self.spark, self.sf_dir, name)


def job(key: str, views: str = "", oracle: str | None = None):
    """Registers ``fn(inputs)`` under a key. The oracle may start with further CTEs
    (``, name AS (..) SELECT ..``)."""

    def register(fn: Callable[[Inputs], DataFrame]):
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ctes = fixtures.with_views(*views.split())
            head = f"WITH RECURSIVE {ctes}\n" if ctes else ""
            ORACLES[key] = head + oracle.strip()
        return fn

    return register


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def load_catalog() -> None:
    if QUERIES:
        return
    folder = os.path.join(os.path.dirname(__file__), "catalog")
    for module in sorted(m.name for m in pkgutil.iter_modules([folder])):
        import_module(f"harness.catalog.{module}")
