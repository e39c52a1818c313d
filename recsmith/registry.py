"""Registry of named queries (Spark callables) and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# fixed value: decimals kept on every float that leaves a checked query
DECIMALS = 6

CATALOG_MODULES = [
    "recsmith.plans.catalog_rank",
    "recsmith.plans.catalog_features",
    "recsmith.plans.catalog_ingest",
    "recsmith.plans.catalog_text",
    "recsmith.plans.catalog_metrics",
    "recsmith.plans.catalog_profile",
    "recsmith.plans.catalog_present",
    "recsmith.plans.catalog_models",
    "recsmith.plans.catalog_joint",
]


def round_floats(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), decimals).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_floats(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def load_all() -> None:
    for m in CATALOG_MODULES:
        importlib.import_module(m)
