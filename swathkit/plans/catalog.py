"""Query names, their callables and their SQL on another engine. Importing the wave modules fills both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name, with the SQL that says the same."""

    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


from . import wave_bands, wave_classes, wave_geometry, wave_grids, wave_io, wave_models, wave_temporal, wave_vectors, wave_zonal  # noqa: E402, F401
