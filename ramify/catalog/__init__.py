"""All registered queries."""

from ramify.catalog import algebra, blocks, solves  # noqa: F401
from ramify.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
