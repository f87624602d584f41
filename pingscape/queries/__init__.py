"""Registered queries over the given tables and their SQL counterparts."""

from . import basic, geo_trajectory, harm, relational, study  # noqa: F401  (fill the registry)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
