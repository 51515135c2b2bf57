"""Collects the engine's queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and derived views of one folder, read on demand: ``t.findings_v``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register ``f(tables)`` under ``name``, with DuckDB SQL over tables and views where SQL can say the same."""

    def add(f: Callable[[Tables], DataFrame]) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = views.duck(oracle)
        return run

    return add
