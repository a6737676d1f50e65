"""All registered queries and the SQL statements that check them."""

from dialtrace.registry import counting, flows, headers, scalars, searching, sources, streams, validation
from dialtrace.registry.base import ORACLE, QUERIES

__all__ = [
    "ORACLE", "QUERIES",
    "counting", "flows", "headers", "scalars", "searching", "sources", "streams", "validation",
]
