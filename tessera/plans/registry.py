"""Queries by name and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import catalog_queries, pixel_queries, store_queries, tile_queries

PARTS = (pixel_queries, tile_queries, catalog_queries, store_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLES.items()}
