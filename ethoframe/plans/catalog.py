"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analysis, frames, models, networks, relations

_PARTS = (frames, analysis, relations, models, networks)
QUERIES: dict = {name: make for part in _PARTS for name, make in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to observations to effects of all pairs of arms."""
    return QUERIES["ead_all_pairs"](spark, sf_dir)
