"""Every query of the engine, gathered from the modules that register them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import registry

FLAGSHIP = "s0_triage_report"
MODULES = ["callrules", "evidence", "findings", "flows", "graphs", "joins", "lifecycle", "more", "programs", "quality", "relational", "resolution", "routes", "rules", "streams", "surface", "values"]
for _name in MODULES:
    importlib.import_module(f"lodestone.plans.{_name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES[FLAGSHIP](spark, sf_dir)
