"""Named queries over the test tables, each with the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftline.session import configure, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read lazily: `t.orders`."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self, name: str) -> str:
        return shared_folder(self.spark, name)


def query(name: str, oracle: str | None = None):
    """Register a function of `Tables` under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name!r} exists already")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add
