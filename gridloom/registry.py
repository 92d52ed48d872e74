"""All queries of the analytics library with the SQL they are checked against."""

from __future__ import annotations

from .plans import cf_queries, grid_queries, more_queries, raster_queries, vector_queries  # noqa: F401
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
