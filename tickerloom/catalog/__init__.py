"""Named queries over the derived research tables, with their SQL checks."""

from tickerloom.catalog import analytics, basics, endpoints, expressions, streams, written  # noqa: F401
from tickerloom.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
