"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_fusion, queries_projection, queries_sources

_PARTS = (queries_sources.catalog, queries_fusion.catalog, queries_projection.catalog)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in _PARTS for k, q in part.queries.items()}
ORACLE_SQL: dict[str, str] = {k: q for part in _PARTS for k, q in part.sql.items()}
entry = queries_fusion.fuse_end_to_end
