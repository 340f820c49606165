"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from rillwork.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
