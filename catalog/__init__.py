"""Registered queries over the driver tables, and the SQL each one has to equal."""

from catalog import explore, features, forecasts, metrics, models, quality, sources, weather  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
