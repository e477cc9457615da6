"""All queries of the core, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import pieces, pipeline, records, statements

QUERIES = {**statements.QUERIES, **records.QUERIES, **pipeline.QUERIES, **pieces.QUERIES}
ORACLES = {**statements.ORACLES, **records.ORACLES, **pipeline.ORACLES, **pieces.ORACLES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query that ``entry`` runs: all metrics of all statements."""
    return QUERIES["metrics_full"](spark, folder)
