"""All registered queries of the planning operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshloom.plans import audit_queries, document_queries, metro_queries, overlay_queries, road_queries, scenario_queries, settings_queries, site_queries, traffic_queries, tree_queries

FLAGSHIP = "gravity_demands"

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (road_queries, metro_queries, traffic_queries, site_queries, scenario_queries, settings_queries, overlay_queries, document_queries, audit_queries, tree_queries)


def queries() -> dict[str, Query]:
    """Name to function of (spark, sf_dir)."""
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
