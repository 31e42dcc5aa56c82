"""Registered queries: each operator over the given tables, with SQL to hold it against."""

from . import events, records, streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
