"""Registered queries over the driver's tables."""

from . import dated, features, lines, more, rasters, relational, reports, scores, shapes, spatial, temporal  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
