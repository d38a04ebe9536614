"""DuckDB statements that state each query independently of the Spark code."""

from oracles.statements import ORACLES

__all__ = ["ORACLES"]
