"""Registered queries over the driver's tables, with the SQL they are checked against."""

from . import services, sessions, traffic  # noqa: F401  they register their queries
from .detection import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
