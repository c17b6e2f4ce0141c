"""Secured views over streams: row filters and projections keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.operators.enforce import secured


def secured_stream(spark: SparkSession, path: str, schema, table: str, role: str, policies: DataFrame) -> DataFrame | None:
    """A file stream as a role may see it."""
    return secured(spark.readStream.schema(schema).parquet(path), table, role, policies)
