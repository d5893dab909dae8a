"""Registered queries and the SQL that gives the same rows."""

from verilith.queries.catalogue import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
