"""All registered queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import commerce, datasets, learning, segmentation, streams, timelines  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
