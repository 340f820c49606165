"""The registered queries and the SQL that each of them is checked against."""

from rillwork.suite import emitted, files, flow, intervals, messages, relational, scalars, similar, streams  # noqa: F401
from rillwork.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
