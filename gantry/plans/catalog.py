"""All queries over the reference's operators, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from gantry.plans import base

GROUPS = ("files", "aggregation", "relational", "windows", "scalars", "generation", "statistics", "incremental", "streams")
for _group in GROUPS:
    importlib.import_module(f"gantry.plans.{_group}")


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["scenario_recommendation"](spark, sf_dir)
