"""Queries over the driver's tables, each with the SQL it is held against."""

from rasterbrook.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
