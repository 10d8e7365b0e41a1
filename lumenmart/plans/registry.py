"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from lumenmart.session import ON_DROP, spread, stage, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: Optional[str] = None):
    """Register a query under a name, with its SQL twin where one exists."""

    def register(build: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


_SHARED: dict[tuple, DataFrame] = {}


def forget_shared() -> None:
    """Drop intermediate tables kept for reuse between queries."""
    _SHARED.clear()


ON_DROP.append(forget_shared)


class Tables:
    """Lazy parquet scans of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """A scan spread over all cores, for work that is heavy per row."""
        return spread(getattr(self, name))

    def shared(self, name: str, build: Callable[["Tables"], DataFrame]) -> DataFrame:
        """An intermediate table written once per session and data folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _SHARED:
            _SHARED[key] = stage(build(self))
        return _SHARED[key]
