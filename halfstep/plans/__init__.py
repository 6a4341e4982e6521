"""Registered queries over the driver's tables, and their SQL."""

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
