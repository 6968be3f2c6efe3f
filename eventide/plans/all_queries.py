"""Importing the modules registers their queries."""

from . import q_joins, q_live, q_measure, q_relational, q_tape  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
