"""All queries of the timeline engine by name, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "der_per_clip"
MODULES = ("timeline_queries", "scoring_queries", "frame_queries", "text_queries", "dataset_queries", "algorithm_queries", "signal_queries", "asset_queries", "fusion_queries", "output_queries")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"timeloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"timeloom.plans.{name}").SQL
    return found
