"""Queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from .plans import content, core, days, pipelines, ranking, reporting  # noqa: F401  registers its queries
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
