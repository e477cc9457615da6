"""The queries of this package and their SQL twins, for the driver."""

from tallyspark.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
