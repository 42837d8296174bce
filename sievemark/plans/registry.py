"""All queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detector_queries, event_log, flow_queries, json_queries, mapping_queries, request_queries, signal_queries, stream_queries

MODULES = [detector_queries, event_log, flow_queries, json_queries, mapping_queries, request_queries, signal_queries, stream_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector_queries.all_default(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
